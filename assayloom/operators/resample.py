"""Class rebalancing: up- and down-sampling, KDE, SMOTE, Tomek links, edited neighbours."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayloom.operators.folds import draw, drawn
from assayloom.operators.neighbours import OTHERS, met_in_blocks, nearest
from assayloom.operators.ordered import running, with_stretch
from assayloom.runtime import kept

#: The bandwidths tried, 20 from a tenth to ten on a log scale.
BANDWIDTHS = np.logspace(-1, 1, 20)


def class_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("target").agg(F.count("*").alias("n"))


def counts_of(df: DataFrame) -> tuple[int, int]:
    """Rows of class 0 and of class 1."""
    got = {r[0]: r[1] for r in class_counts(df).collect()}
    return got.get(0, 0), got.get(1, 0)


def deltas(n0: int, n1: int, ratio: float, total: int) -> tuple[int, int]:
    """Rows to add to (or, negative, take from) classes 0 and 1 for ``total`` rows at ``ratio`` of class 1 to class 0."""
    if ratio <= 0 or total <= 0:
        raise ValueError("ratio and total are positive")
    healthy = round(total / (1 + ratio))
    return healthy - n0, total - healthy - n1


def delta_table(df: DataFrame, ratio: float, total: int) -> DataFrame:
    """(target long, delta long): the same as a table, counted in one aggregation."""
    d0, d1 = deltas(0, 0, ratio, total)
    counts = df.agg(F.count_if(F.col("target") == 0).alias("n0"), F.count_if(F.col("target") == 1).alias("n1"))
    one = lambda c, d: F.struct(F.lit(c).cast("long").alias("target"), (F.lit(d) - F.col(f"n{c}")).cast("long").alias("delta"))
    return counts.select(F.inline(F.array(one(0, d0), one(1, d1))))


def down_sample(df: DataFrame, wanted: dict[int, int], seed: int = 0) -> DataFrame:
    """``wanted`` rows of each class named, without replacement; other classes stay."""
    limit = F.coalesce(*(F.when(F.col("target") == c, F.lit(n)) for c, n in wanted.items()), F.lit(None).cast("int"))
    ranked = drawn(df, ("target",), draw(seed, "id"))
    return ranked.filter(limit.isNull() | (F.col("__rank") <= limit)).drop("__rank", "all___rank")


def _kernel_sums(ida: np.ndarray, xa: np.ndarray, idb: np.ndarray, xb: np.ndarray) -> list[tuple]:
    """(id, b, top, rest) of each row and bandwidth: exp(top) * rest is the kernels' sum over the rows of other folds (the last coordinate)."""
    a, b = xa[:, :-1], xb[:, :-1]
    d2 = np.maximum((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1) - 2 * a @ b.T, 0)
    d2[xa[:, -1][:, None] == xb[:, -1]] = np.inf
    seen = np.isfinite(d2).any(axis=1)
    d2, ids, out = d2[seen], ida[seen], []
    nearest_d2 = d2.min(axis=1) if len(d2) else np.zeros(0)
    for k, h in enumerate(BANDWIDTHS):
        scale = -2 * h * h
        out.append((ids, np.full(len(ids), k), nearest_d2 / scale, np.exp((d2 - nearest_d2[:, None]) / scale).sum(axis=1)))
    return out


def best_bandwidth(df: DataFrame, folds: int = 5) -> float:
    """The Gaussian bandwidth with the best held-out likelihood of (id, x array<double>); a single row has the smallest.

    Blocks of rows meet blocks of rows once; the distances of a pair of blocks serve all bandwidths and folds, and a block sends its
    largest term and the sum relative to it, which can be added up in any order."""
    n = df.count()
    k = max(2, min(folds, n))
    numbered = running(with_stretch(df.select("id", "x"), "id"), (), F.col("__stretch"), [F.col("id")], {"__k": F.lit(1).cast("long")})
    folded = kept(numbered.select("id", F.array_append(F.col("x").cast("array<double>"), F.pmod(F.col("__k") - 1, F.lit(k)).cast("double")).alias("x")))
    blocks = max(1, -(-n // OTHERS))
    asked = folded.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    placed = folded.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    parts = met_in_blocks(asked, placed, _kernel_sums, {"id": pa.int64(), "b": pa.int64(), "top": pa.float64(), "rest": pa.float64()})
    state = parts.groupBy("id", "b").agg(F.max("top").alias("top"), F.collect_list(F.struct("top", "rest")).alias("s"))
    total = F.aggregate("s", F.lit(0.0), lambda t, s: t + s["rest"] * F.exp(s["top"] - F.col("top")))
    sizes = folded.groupBy(F.element_at("x", -1).alias("fold")).agg((F.lit(n) - F.count("*")).alias("train"))
    rows = folded.select("id", F.element_at("x", -1).alias("fold"), (F.size("x") - 1).alias("width")).join(F.broadcast(sizes), "fold")  # a row a fold
    log_h = F.element_at(F.array(*(F.lit(float(np.log(h) + 0.5 * np.log(2 * np.pi))) for h in BANDWIDTHS)), (F.col("b") + 1).cast("int"))
    scored = state.withColumn("total", total).join(rows, "id").groupBy("b").agg(F.sum(F.col("top") + F.log("total") - F.log("train") - F.col("width") * log_h).alias("ll"))
    best = scored.orderBy(F.desc("ll"), "b").first()
    return float(BANDWIDTHS[best[0] if best else 0])


def _numbered(df: DataFrame) -> DataFrame:
    """``df`` with __k, the row's number in its class by id, from 0."""
    ranked = running(with_stretch(df, "id"), ("target",), F.col("__stretch"), [F.col("id")], {"__k": F.lit(1).cast("long")})
    return ranked.withColumn("__k", F.col("__k") - 1).drop("__stretch", "all___k")


def kde_up_sample(df: DataFrame, target: int, extra: int, seed: int = 0, first: int = 0) -> DataFrame:
    """The new rows only: a random row of class ``target`` plus Gaussian noise of the best bandwidth; ids count down from -1 - first."""
    own = df.filter(F.col("target") == target)
    n = own.count()
    if extra <= 0 or not n:
        return df.filter(F.lit(False)).select("id", "target", "x")
    h = best_bandwidth(own)
    new = df.sparkSession.range(extra).select((-1 - F.col("id") - first).alias("id"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(n)).alias("__k"))
    width = own.select(F.max(F.size("x"))).first()[0]
    made = new.join(_numbered(own).select("__k", "target", "x"), "__k")

    def noisy(parts):
        for pdf in parts:
            pdf["x"] = [(np.asarray(x, float) + h * np.random.default_rng([seed, -i]).standard_normal(width)).tolist() for i, x in zip(pdf["id"], pdf["x"], strict=True)]
            yield pdf[["id", "target", "x"]]

    return made.mapInPandas(noisy, f"id long, target {dict(df.dtypes)['target']}, x array<double>")


def rebalance(df: DataFrame, ratio: float = 0.5, total: int = 100, seed: int = 0) -> DataFrame:
    """(id, target, x): ``total`` rows at ``ratio`` of class 1 to class 0, class 0 first sampled down or filled up, then class 1."""
    n0, n1 = counts_of(df)
    d0, d1 = deltas(n0, n1, ratio, total)
    kept = down_sample(df.select("id", "target", "x"), {c: n + d for c, n, d in ((0, n0, d0), (1, n1, d1)) if d < 0}, seed) if min(d0, d1) < 0 else df.select("id", "target", "x")
    return kept.unionByName(kde_up_sample(df, 0, d0, seed)).unionByName(kde_up_sample(df, 1, d1, seed, max(0, d0)))


def smote_neighbours(df: DataFrame, k: int = 5) -> DataFrame:
    """(id, nid, rank): the ``k`` nearest rows of the same, smaller class (class 1 if they are equal)."""
    n0, n1 = counts_of(df)
    return nearest(df.filter(F.col("target") == (1 if n1 <= n0 else 0)).select("id", "x"), k)


def smote(df: DataFrame, target: int, extra: int, k: int = 5, seed: int = 0) -> DataFrame:
    """The new rows only: points between a random row of the class and one of its ``k`` nearest of the class."""
    own = df.filter(F.col("target") == target).select("id", "target", "x")
    n = own.count()
    if extra <= 0 or n < 2:
        return own.filter(F.lit(False))
    near = nearest(own.select("id", "x"), k).select("id", "nid", "rank").join(own.select(F.col("id").alias("nid"), F.col("x").alias("nx")), "nid")
    new = df.sparkSession.range(extra).select((-1 - F.col("id")).alias("new"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(n)).alias("__k"), (F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(min(k, n - 1))) + 1).alias("rank"), (F.pmod(F.xxhash64(F.lit(seed + 2), "id"), F.lit(1 << 30)) / float(1 << 30)).alias("u"))
    return new.join(_numbered(own), "__k").join(near, ["id", "rank"]).select(F.col("new").alias("id"), "target", F.zip_with("x", "nx", lambda a, b: a + F.col("u") * (b - a)).alias("x"))


def tomek_links(df: DataFrame) -> DataFrame:
    """(a, b) of rows of different classes that are each other's nearest, a < b."""
    near = nearest(df.select("id", "x"), 1).select("id", "nid")
    back = near.select(F.col("id").alias("nid"), F.col("nid").alias("id"))
    of = df.select("id", "target")
    return near.join(back, ["id", "nid"]).filter("id < nid").join(of, "id").join(of.toDF("nid", "other"), "nid").filter("target <> other").select(F.col("id").alias("a"), F.col("nid").alias("b"))


def drop_tomek(df: DataFrame) -> DataFrame:
    links = tomek_links(df)
    return df.join(links.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_anti")


def edited(df: DataFrame, k: int = 3) -> DataFrame:
    """Rows whose ``k`` nearest are all of their class."""
    votes = nearest(df.select("id", "x"), k).join(df.select(F.col("id").alias("nid"), F.col("target").alias("vote")), "nid")
    odd = votes.join(df.select("id", "target"), "id").filter("vote <> target").select("id").distinct()
    return df.join(odd, "id", "left_anti")


def name_new(rows: DataFrame, patients: DataFrame) -> DataFrame:
    """``rows`` (id, target, x) with the patient_id and label that ``patients`` (id, patient_id, label) has; new rows, which it does not
    have, are called AUG0, AUG1 and so on in both."""
    known = rows.join(patients.select("id", F.col("patient_id").cast("string").alias("patient_id"), F.col("label").cast("string").alias("label")), "id", "left")
    new = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("id"))) - 1  # as short as the matrix
    made = known.filter("id < 0 and patient_id is null").withColumn("name", F.concat(F.lit("AUG"), new.cast("string")))
    made = made.select("id", "target", "x", F.col("name").alias("patient_id"), F.col("name").alias("label"))
    return known.filter("not (id < 0 and patient_id is null)").unionByName(made)


def class_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """(stage, total, positive, negative, ratio) before and after rows were added or left out; ratio is the share of class 1."""
    one = lambda df, name: df.agg(F.lit(name).alias("stage"), F.count("*").alias("total"), F.count_if(F.col("target") == 1).alias("positive"), F.count_if(F.col("target") == 0).alias("negative"), F.avg(F.col("target").cast("double")).alias("ratio"))
    return one(before, "before").unionByName(one(after, "after"))


def augment(df: DataFrame, how: str, ratio: float = 0.5, total: int = 0, seed: int = 0) -> DataFrame:
    """Rows (id, target, x) rebalanced by name: none, kde, kde_balanced, smote_balanced, smote_tomek, smote_enn, ratio.

    ``ratio`` is class 1 to class 0 for kde; for "ratio" it is the share of class 1. ``total`` rescales the result, both classes alike.
    New rows have negative ids; name_new names them."""
    df = df.select("id", "target", "x")
    n0, n1 = counts_of(df)
    if how == "none":
        return df
    if how == "kde":
        return rebalance(df, ratio, total, seed)
    if how == "kde_balanced":
        return rebalance(df, 1.0, 2 * max(n0, n1), seed)
    small, gap = (1, n0 - n1) if n1 <= n0 else (0, n1 - n0)
    if how in ("smote_balanced", "smote_tomek", "smote_enn"):
        out = df.unionByName(smote(df, small, gap, seed=seed))
        out = drop_tomek(out) if how == "smote_tomek" else edited(out) if how == "smote_enn" else out
    elif how == "ratio":
        wanted = int(n1 * (1 - ratio) / ratio)
        out = df.unionByName(smote(df, 0, wanted - n0, seed=seed)) if wanted > n0 else down_sample(df, {0: wanted}, seed)
    else:
        raise ValueError(f"no such augmentation: {how}")
    if total:
        m0, m1 = counts_of(out)
        for c, n in ((0, math.ceil(total * m0 / (m0 + m1))), (1, math.ceil(total * m1 / (m0 + m1)))):
            have = m1 if c else m0
            grown = smote(out, c, n - have, seed=seed).withColumn("id", F.col("id") - 1_000_000_000 * (c + 1))
            out = out.unionByName(grown) if n > have else down_sample(out, {c: n}, seed)
    return out
