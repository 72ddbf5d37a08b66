"""Splits: ranks by a seeded digest of the id, so that they do not depend on how rows are spread."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayloom.operators.ordered import running


def draw(seed: int, *parts: str | Column) -> Column:
    """A text to order rows by, as good as random: md5 of the seed and the parts."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *(c.cast("string") for c in cols)).cast("binary"))


def _repeated(df: DataFrame, repeats: int) -> DataFrame:
    return df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)).cast("array<long>")))


def drawn(df: DataFrame, by: tuple[str, ...], digest: Column) -> DataFrame:
    """``df`` with __rank, a row's place (from 1) in its group by the digest, then the id, and all___rank, the group's rows.

    The digest's first three digits are the row's stretch, so a group of any size is spread over 4,096 of them."""
    ranked = running(df.withColumn("__digest", digest), by, F.substring("__digest", 1, 3), [F.col("__digest"), F.col("id")], {"__rank": F.lit(1).cast("long")})
    return ranked.drop("__digest")


def repeated_stratified_folds(df: DataFrame, k: int, repeats: int, seed: int = 0, target: str = "target") -> DataFrame:
    """``df`` once a repeat, with repeat and fold (0..k-1): each fold's share of every class differs by one row at most."""
    ranked = drawn(_repeated(df, repeats), ("repeat", target), draw(seed, "repeat", "id"))
    return ranked.withColumn("fold", F.pmod(F.col("__rank") - 1, F.lit(k)).cast("long")).drop("__rank", "all___rank")


def shuffle_splits(df: DataFrame, splits: int, test: float = 0.3, seed: int = 0) -> DataFrame:
    """``df`` once a split, with repeat and test: ceil(test * n) rows of each split, whatever their class."""
    ranked = drawn(_repeated(df, splits), ("repeat",), draw(seed, "repeat", "id"))
    return ranked.withColumn("test", F.col("__rank") <= F.ceil(F.lit(test) * F.col("all___rank"))).drop("__rank", "all___rank")


def stratified_split(df: DataFrame, share: float, seed: int = 0, target: str = "target") -> DataFrame:
    """``df`` with test: round(share * n) rows of each class."""
    ranked = drawn(df, (target,), draw(seed, "id"))
    return ranked.withColumn("test", F.col("__rank") <= F.floor(F.lit(share) * F.col("all___rank") + 0.5)).drop("__rank", "all___rank")


#: Boots that are drawn together, rows of a leaf of the tree that are aimed at, and levels of it at most.
BOOTS, LEAF_ROWS, LEVELS = 64, 1024, 12


def _shares(rng_key: list[int], m: np.ndarray, share: np.ndarray | float) -> np.ndarray:
    """How many of ``m`` draws go to the left, which has that share of the rows."""
    return np.random.default_rng(rng_key).binomial(m, share)


def _leaf_draws(sizes: np.ndarray, leaf: int, levels: int, seed: int, chunk: int, boots: int) -> np.ndarray:
    """The draws of each boot that fall into a leaf: from the root on, a node's go to its two halves by their sizes. Whoever asks for a leaf
    draws the same at every node on the way."""
    ends = np.concatenate(([0], np.cumsum(sizes)))
    m, a, b = np.full(boots, ends[-1]), 0, len(sizes)
    for level in range(levels):
        mid = (a + b) // 2
        left = _shares([seed, chunk, level, a], m, (ends[mid] - ends[a]) / max(1, ends[b] - ends[a]))
        a, b, m = (a, mid, left) if leaf < mid else (mid, b, m - left)
    return m


def _row_draws(m: np.ndarray, n: int, key: list[int]) -> np.ndarray:
    """The draws (a row a boot's weight each) of ``n`` rows among which ``m`` fall, by halves again."""
    lo, hi, m, depth = np.array([0]), np.array([n]), m[None, :], 0
    while (hi - lo > 1).any():
        mid = (lo + hi) // 2
        left = _shares([*key, depth], m, ((mid - lo) / (hi - lo))[:, None])
        lo, hi, m = np.stack((lo, mid), axis=1).ravel(), np.stack((mid, hi), axis=1).ravel(), np.stack((left, m - left), axis=1).reshape(-1, m.shape[1])
        some = hi > lo
        lo, hi, m, depth = lo[some], hi[some], m[some], depth + 1
    return m


def bootstrap(df: DataFrame, n_bootstraps: int, seed: int = 0) -> DataFrame:
    """``df`` once a boot that draws it, with boot and weight: how often the row is drawn when as many rows as there are are drawn with replacement.

    Draws are multinomial, exactly: all n of a boot start at the root of a tree over the hashes of the ids and are split binomially at each node, by
    the rows on either side, down to the rows. What is drawn at a node depends on the seed and the node only, so every leaf finds
    its own, the weights of a boot add up to n, and reruns agree however rows are spread. Rows are dealt out once, whatever the number of boots."""
    hashed = df.withColumn("__h", F.xxhash64(F.lit(seed), F.col("id").cast("string")))
    n = df.count()
    levels = max(0, min(LEVELS, int(np.ceil(np.log2(max(1, n) / LEAF_ROWS)))))
    placed = hashed.withColumn("__leaf", F.shiftrightunsigned("__h", 64 - levels) if levels else F.lit(0).cast("long"))
    sizes = np.zeros(1 << levels, np.int64)
    for r in placed.groupBy("__leaf").count().collect():  # a row a leaf
        sizes[r[0]] = r[1]

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf, table = key[0].as_py(), pa.Table.from_batches(batches).sort_by([("__h", "ascending"), ("id", "ascending")])
        own = table.drop_columns(["__h", "__leaf"]).combine_chunks()
        for chunk in range(-(-n_bootstraps // BOOTS)):
            m = _leaf_draws(sizes, leaf, levels, seed, chunk, BOOTS)
            weight = _row_draws(m, len(table), [seed, chunk, LEVELS, leaf])[:, : n_bootstraps - chunk * BOOTS]
            row, boot = np.nonzero(weight)
            drawn = own.take(pa.array(row)).append_column("boot", pa.array(boot + chunk * BOOTS, pa.int64())).append_column("weight", pa.array(weight[row, boot], pa.int64()))
            yield from drawn.combine_chunks().to_batches()

    schema = T.StructType([*df.schema.fields, T.StructField("boot", T.LongType()), T.StructField("weight", T.LongType())])
    return placed.groupBy("__leaf").applyInArrow(run, schema)
