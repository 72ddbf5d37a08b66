"""Exact top-k inner products by block-at-a-time pruning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayloom.llm.common import cut, dense

#: Documents of a block and of a shard, queries of a batch, shard summaries that one task compares with a batch.
BLOCK, SHARD, BATCH, SUMMARIES = 64, 16_384, 4096, 1024
#: Blocks scored between two looks at the bounds.
WAVE = 4
#: Shards' pivots at most, and the rows they are taken from.
PIVOTS, SAMPLE = 1024, 16_384
#: Components that one task (or the driver, for the sample) holds; wide vectors make smaller shards, batches and samples.
COMPONENTS = 1 << 22


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id long, v array<long>, high double): floor(scale * x) of every component as double, and the largest |scale * x|; vectors that
    are null or hold a null or non-finite component are left out, empty ones are not."""
    e = F.col("embedding").cast("array<double>")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding")).filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine)
    high = F.aggregate("embedding", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x * scale)))
    return kept.select("vec_id", F.transform("embedding", lambda x: F.floor(x * scale)).alias("v"), high.alias("high"))


class _Shard:
    """A shard's documents in blocks: forward indexes, and the largest and smallest weight of each term in each block."""

    def __init__(self, uids: np.ndarray, ids: np.ndarray, rows: np.ndarray):
        # Alike documents side by side make blocks whose bounds are close; ties go by id, so the order is free.
        near_rows = rows.astype(np.float64)
        pivots = near_rows[np.linspace(0, len(rows) - 1, min(len(rows), 128)).astype(int)]
        gap = -2 * near_rows @ pivots.T + (pivots * pivots).sum(axis=1)
        near = gap.argmin(axis=1)
        order = np.lexsort((uids, gap[np.arange(len(rows)), near], near))
        self.uids, self.ids, self.rows = uids[order], ids[order], rows[order]
        self.starts = np.arange(0, len(ids), BLOCK)
        self.most, self.least = np.maximum.reduceat(self.rows, self.starts), np.minimum.reduceat(self.rows, self.starts)
        pad = -len(ids) % BLOCK
        self.rows = np.concatenate((self.rows, np.zeros((pad, rows.shape[1]), rows.dtype))).reshape(-1, BLOCK, rows.shape[1])
        self.uids, self.ids = (np.concatenate((x, np.full(pad, np.iinfo(np.int64).max))).reshape(-1, BLOCK) for x in (self.uids, self.ids))
        self.real = np.arange(len(self.starts) * BLOCK).reshape(-1, BLOCK) < len(ids)

    def search(self, own: int, query: np.ndarray, bound: np.ndarray, k: int, least: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best k rows other than ``own`` with ``least`` or more, ties to the smaller id: blocks by falling bound
        until it is below the kth."""
        order = np.argsort(-bound, kind="stable")
        ids, scores, floor = np.zeros(0, np.int64), np.zeros(0, self.rows.dtype), least
        for a in range(0, len(order), WAVE):
            take = order[a : a + WAVE]
            if floor is not None and bound[take[0]] < floor:  # at an equal bound a smaller id may still come
                break
            got = self.rows[take] @ query
            fit = self.real[take] & (self.uids[take] != own)
            if floor is not None:
                fit &= got >= floor
            ids, scores = np.concatenate((ids, self.ids[take][fit])), np.concatenate((scores, got[fit]))
            best = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
            if len(ids) == k:
                floor = scores[-1]
        return ids, scores


def _bounds(queries: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The summed term maxima of each block (or shard) for each query."""
    return np.maximum(queries, 0) @ most.T + np.minimum(queries, 0) @ least.T


HITS = "uid long, query_id long, vec_id long, score long"


def _hits(shard: _Shard, uids: np.ndarray, ids: np.ndarray, queries: np.ndarray, least: list, k: int) -> dict[str, np.ndarray]:
    out = []
    for uid, q, query, bound, low in zip(uids, ids, queries, _bounds(queries, shard.most, shard.least), least, strict=True):
        found, scores = shard.search(uid, query, bound, k, low)
        out.append((np.full(len(found), uid), np.full(len(found), q), found, scores.astype(np.int64)))
    columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
    return dict(zip(("uid", "query_id", "vec_id", "score"), columns, strict=True))


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64) -> DataFrame:
    """(query_id long, rank int, vec_id long, score long): the k highest integer inner products of each query with all other rows.

    Queries are the rows whose vec_id is divisible by ``every``. Fewer than k others give all of them; ties go to the smaller
    vec_id. Rows repeating a vec_id are rows of their own, as candidates and as queries. A vector shorter than others has zeros
    there. Rows without a vec_id and vectors that quantised() leaves out take no part; an empty table gives no rows. Scores are
    computed in doubles where these are exact, else in 64-bit integers; where even these could overflow, the call raises.

    Documents are dealt into shards by the nearest of some pivots, and shards into blocks. A query is searched in its own shard
    first, so that it has a kth score; after that it is sent only to shards whose bound reaches that score, and there starts with
    it. A task holds one shard and a batch of queries, and sends k rows a query.
    """
    spark = vectors.sparkSession
    rows = cut(quantised(vectors, scale).withColumn("uid", F.monotonically_increasing_id()))
    n, width, high = rows.agg(F.count("*"), F.max(F.size("v")), F.max("high")).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(width, 1)
    most = width * (high + 1) * (high + 1)  # a power would raise where this is infinite
    if most >= 2.0**63:
        raise ValueError("components are too large for scores of 64 bits")
    kind = np.float64 if most < 2.0**53 else np.int64
    shard_rows, batch_rows, sample_rows = (max(1, min(n_rows, COMPONENTS // width)) for n_rows in (SHARD, BATCH, SAMPLE))

    share = (F.shiftright(F.xxhash64("uid"), 11) + F.lit(1 << 52)) / float(1 << 53)  # 0 to 1
    sample = [r[0] for r in rows.filter(share * n < sample_rows).select("v").limit(sample_rows).collect()] if n > shard_rows else []
    pivots = np.zeros((1, width))
    if sample:
        sample.sort()
        pivots = dense(pa.array(sample, pa.list_(pa.int64())), width)[np.random.default_rng(1).choice(len(sample), min(len(sample), PIVOTS, -(-n // shard_rows)), replace=False)]
    sent = spark.sparkContext.broadcast(pivots)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for batch in batches:
            gap = -2 * dense(batch.column(2), width) @ c.T + (c * c).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(gap.argmin(axis=1))], ["uid", "vec_id", "v", "shard"])

    dealt = cut(rows.select("uid", "vec_id", "v").mapInArrow(deal, "uid long, vec_id long, v array<long>, shard long"))
    sizes = dealt.groupBy("shard").agg(F.ceil(F.count("*") / shard_rows).alias("parts"))
    placed = dealt.join(F.broadcast(sizes), "shard").withColumn("part", F.pmod(F.xxhash64("uid", F.lit(1)), "parts")).drop("parts")  # PIVOTS rows at most

    def first(group: pa.Table) -> pa.Table:
        uids, ids, v = group["uid"].to_numpy(), group["vec_id"].to_numpy(), dense(group["v"], width, kind)
        shard, own = _Shard(uids, ids, v), np.flatnonzero(ids % every == 0)
        hits = _hits(shard, uids[own], ids[own], v[own], [None] * len(own), k)
        low, top = shard.least.min(axis=0), shard.most.max(axis=0)
        summary = {"uid": [None], "query_id": [None], "vec_id": [None], "score": [None], "shard": group["shard"][:1], "part": group["part"][:1], "most": [top.tobytes()], "least": [low.tobytes()]}
        names = ("shard", "part", "most", "least")
        kinds = dict(zip(("uid", "query_id", "vec_id", "score", *names), (pa.int64(),) * 6 + (pa.binary(),) * 2, strict=True))
        blank = {c: pa.nulls(len(hits["uid"]), kinds[c]) for c in names}
        join = lambda a, b, t: pa.chunked_array([pa.array(a, t), b.combine_chunks().cast(t) if isinstance(b, pa.ChunkedArray) else pa.array(b, t)])
        return pa.table({c: join((hits | blank)[c], summary[c], t) for c, t in kinds.items()})

    near = cut(placed.groupBy("shard", "part").applyInArrow(first, f"{HITS}, shard long, part long, most binary, least binary"))
    home = near.filter("uid is not null").select("uid", "query_id", "vec_id", "score")
    kth = home.groupBy("uid").agg(F.when(F.count("*") >= k, F.min("score")).alias("low"))
    asked = placed.filter(F.col("vec_id") % every == 0).join(kth, "uid", "left").select("uid", F.col("vec_id").alias("query_id"), "v", "low", F.col("shard").alias("own_shard"), F.col("part").alias("own_part"))

    # Summaries, a row a shard, and batches of queries meet once each.
    summaries = near.filter("uid is null").select("shard", "part", "most", "least")
    shards, queries = summaries.count(), asked.count()
    slices, batches = max(1, -(-shards // SUMMARIES)), max(1, -(-queries // batch_rows))
    span = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    met = summaries.withColumn("slice", F.pmod(F.xxhash64("shard", "part"), F.lit(slices))).withColumn("batch", span(batches))
    each = asked.withColumn("batch", F.pmod(F.xxhash64("uid", F.lit(2)), F.lit(batches))).withColumn("slice", span(slices))

    def reach(bounds: pa.Table, asked: pa.Table) -> pa.Table:
        out = {c: [] for c in ("shard", "part")}
        take = []
        if len(bounds) and len(asked):
            v, low = dense(asked["v"], width, kind), asked["low"].to_pylist()
            most, least = (np.array([np.frombuffer(x, kind) for x in bounds[c].to_pylist()]).reshape(-1, width) for c in ("most", "least"))
            floor = np.array([-np.inf if x is None else x for x in low])
            fit = _bounds(v, most, least) >= floor[:, None]
            shard, part = bounds["shard"].to_numpy(), bounds["part"].to_numpy()
            fit &= (asked["own_shard"].to_numpy()[:, None] != shard) | (asked["own_part"].to_numpy()[:, None] != part)
            take, which = np.nonzero(fit)
            out = {"shard": shard[which], "part": part[which]}
        sent = asked.select(["uid", "query_id", "v", "low"]).take(pa.array(take, pa.int64()))
        return pa.table({**{c: pa.array(x, pa.int64()) for c, x in out.items()}, **{c: sent[c] for c in sent.column_names}})

    reached = cut(met.groupBy("slice", "batch").cogroup(each.groupBy("slice", "batch")).applyInArrow(reach, "shard long, part long, uid long, query_id long, v array<long>, low long"))
    turns = reached.groupBy("shard", "part").agg(F.ceil(F.count("*") / batch_rows).alias("turns"))
    docs = placed.join(turns, ["shard", "part"]).select("shard", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)).alias("turn"), "uid", "vec_id", "v")
    wanted = reached.join(turns, ["shard", "part"]).withColumn("turn", F.pmod(F.xxhash64("uid", F.lit(3)), "turns")).drop("turns")

    def score(docs: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(docs) or not len(asked):
            return pa.table({c: pa.nulls(0, pa.int64()) for c in ("uid", "query_id", "vec_id", "score")})
        shard = _Shard(docs["uid"].to_numpy(), docs["vec_id"].to_numpy(), dense(docs["v"], width, kind))
        return pa.table(_hits(shard, asked["uid"].to_numpy(), asked["query_id"].to_numpy(), dense(asked["v"], width, kind), asked["low"].to_pylist(), k))

    docs, wanted = (df.toDF(*df.columns) for df in (docs, wanted))  # both come from the same rows
    far = docs.groupBy("shard", "part", "turn").cogroup(wanted.groupBy("shard", "part", "turn")).applyInArrow(score, HITS)
    rank = F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id"))
    return home.unionAll(far).withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
