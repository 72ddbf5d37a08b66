"""Near-duplicate vectors from flat, robust-pruned graphs built on overlapping cluster shards."""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayloom.llm.common import cut, dense, mix, spread_join
from assayloom.llm.components import connected_components

#: Nodes of a cell on average, at most in one task, and those from which on a cell is split by centroids of its own.
CELL, MOST, SPLIT = 4096, 8192, 32_768
#: Components of vectors that one task holds; wide vectors make smaller slices of cells and smaller samples.
COMPONENTS = 1 << 22
#: Nodes of a build shard within a cell.
SHARD = 2048
#: Centroids that one fit learns at most, and how often a cell is split at most.
CENTRES, LEVELS = 1024, 3
#: Out-degree after pruning, candidates before it, random candidates among these, and the pruning factor.
DEGREE, POOL, FAR, ALPHA = 24, 64, 16, 1.2
BEAM, BATCH = 16, 512
#: Pairs verified at once.
PAIRS = 1 << 17
#: Vectors this much farther than the range are still walked through.
SLACK = 0.05
SEED = 7


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, e array<double>) of the vectors that can link: not null or zero, all components finite and not null."""
    e = F.col("embedding").cast("array<double>")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("e")).filter(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & fine & F.exists("e", lambda x: x != 0))


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.maximum(np.abs(rows).max(axis=1, keepdims=True), 1e-300)  # first by the largest, so that no square overflows
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _fit(x: np.ndarray, k: int) -> np.ndarray:
    """Unit centroids of unit vectors, by Lloyd's rounds from seeded rows."""
    x = x.astype(np.float32)
    c = x[np.random.default_rng(SEED).choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(8):
        near = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 0, sums / np.maximum(size, 1e-9), c)
    return c


def _apart(c: np.ndarray, least: float, overlap: int) -> np.ndarray:
    """Centroids of which no two are in range of each other: what is denser than the range is not divided, as most of its pairs link.
    Only one, which divides nothing, where so few are left that overlapping cells would hardly be smaller than the whole."""
    kept = []
    for row in c:
        if not kept or (np.array(kept) @ row).max() < least:
            kept.append(row)
    return np.array(kept if len(kept) > 2 * overlap else kept[:1])


def _nearest(x: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest centroids of each row, fewer if there are fewer."""
    return np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :n]


def _build(x: np.ndarray) -> tuple[list[np.ndarray], int]:
    """The robust-pruned out-neighbours of each vector, reverse edges included, and the medoid's place."""
    n = len(x)
    if n == 1:
        return [np.zeros(0, np.int64)], 0
    sims = x @ x.T
    np.fill_diagonal(sims, -2)
    near = min(POOL - FAR, n - 1)
    pool = np.argpartition(-sims, near - 1, axis=1)[:, :near] if near < n - 1 else np.argsort(-sims, axis=1)[:, :near]
    pool = np.concatenate((pool, np.random.default_rng(SEED).integers(0, n, (n, FAR))), axis=1)
    own = np.arange(n)
    gap = 2 - 2 * np.take_along_axis(sims, pool, axis=1)  # squared distances to the candidates
    gap[pool == own[:, None]] = np.inf
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(DEGREE):
        best = gap.argmin(axis=1)
        open_ = np.isfinite(gap[own, best])
        if not open_.any():
            break
        star = pool[own, best]
        kept.append((own[open_], star[open_]))
        between = np.maximum(2 - 2 * sims[star[:, None], pool], 0)
        between[pool == star[:, None]] = 0
        gap[ALPHA**2 * between <= np.maximum(gap, 0)] = np.inf
        gap[own, best] = np.inf
    a, b = (np.concatenate(k) for k in zip(*kept, strict=True))
    pairs = np.unique(np.concatenate((a * n + b, b * n + a)))
    a, b = pairs // n, pairs % n
    rank = np.lexsort((b, -sims[a, b], a))
    a, b = a[rank], b[rank]
    first = np.searchsorted(a, own)
    place = np.arange(len(a)) - first[a]
    own_most = place < 2 * DEGREE  # a hub keeps its nearest
    a, b = a[own_most], b[own_most]
    return np.split(b, np.searchsorted(a, own[1:])), int((x @ x.mean(axis=0)).argmax())


class _Cell:
    """Vectors of a cell with the union of the adjacency lists from its shards, and the shards' medoids."""

    def __init__(self, exact: np.ndarray, overlap: int):
        self.x = exact.astype(np.float32)
        n = len(exact)
        near = _nearest(self.x, _fit(self.x, max(1, -(-overlap * n // SHARD))), overlap)
        pairs, medoids = [], []
        for s in range(near.max() + 1):
            own = np.flatnonzero((near == s).any(axis=1))
            for part in np.array_split(own, max(1, -(-len(own) // SHARD))):  # rows come in the order of a hash
                if len(part):
                    lists, medoid = _build(self.x[part])
                    medoids.append(part[medoid])
                    a = np.repeat(part, [len(b) for b in lists])
                    pairs.append(np.unique(a * n + part[np.concatenate(lists).astype(np.int64)]) if len(a) else np.zeros(0, np.int64))
        pairs = np.unique(np.concatenate(pairs))
        a, b = pairs // n, pairs % n
        place = np.arange(len(a)) - np.searchsorted(a, a)
        self.next = np.full((n, int(place.max(initial=0)) + 1), -1)
        self.next[a, place] = b
        self.medoids = np.unique(medoids)

    def search(self, q: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, place) pairs within the range of unit queries: a greedy beam from the medoids, then out from all that is near."""
        n, m, x = len(self.x), len(q), self.x
        seen = np.zeros((m, n), bool)
        beam = np.broadcast_to(self.medoids, (m, len(self.medoids))).copy()
        sims = q @ x[self.medoids].T
        seen[:, self.medoids] = True
        done = np.zeros(beam.shape, bool)
        hits = [np.nonzero(sims >= least - SLACK)]
        hits = [(hits[0][0], self.medoids[hits[0][1]])]
        rows = np.arange(m)
        while len(rows):
            best = np.where(done[rows], -np.inf, sims[rows])
            at = best.argmax(axis=1)
            rows, at = (v[np.isfinite(best[np.arange(len(rows)), at])] for v in (rows, at))
            if not len(rows):
                break
            done[rows, at] = True
            nxt = self.next[beam[rows, at]]
            fresh = (nxt >= 0) & ~seen[rows[:, None], nxt]
            r, c = np.nonzero(fresh)
            seen[rows[r], nxt[r, c]] = True
            got = np.full(nxt.shape, -np.inf, np.float32)
            got[r, c] = np.einsum("ij,ij->i", x[nxt[r, c]], q[rows[r]])
            near = got >= least - SLACK
            hits.append((rows[np.nonzero(near)[0]], nxt[near]))
            full_b, full_s, full_d = (np.concatenate(p, axis=1) for p in ((beam[rows], nxt), (sims[rows], got), (done[rows], ~fresh)))
            if full_b.shape[1] > BEAM:
                keep = np.argpartition(-full_s, BEAM - 1, axis=1)[:, :BEAM]
                full_b, full_s, full_d = (np.take_along_axis(p, keep, axis=1) for p in (full_b, full_s, full_d))
            if full_b.shape[1] != beam.shape[1]:
                grow = full_b.shape[1]
                wide_b, wide_s, wide_d = np.zeros((m, grow), beam.dtype), np.full((m, grow), -np.inf, np.float32), np.ones((m, grow), bool)
                keep = min(grow, beam.shape[1])
                wide_b[:, :keep], wide_s[:, :keep], wide_d[:, :keep] = beam[:, :keep], sims[:, :keep], done[:, :keep]
                beam, sims, done = wide_b, wide_s, wide_d
            beam[rows], sims[rows], done[rows] = full_b, full_s, full_d
        # Range expansion: whatever is near leads on, until nothing new is.
        pairs = [tuple(np.concatenate(h) for h in zip(*hits, strict=True))]
        front = pairs[0]
        while len(front[0]):
            new_q, new_v = [], []
            for a in range(0, len(front[0]), 1 << 17):
                fq, fv = front[0][a : a + (1 << 17)], front[1][a : a + (1 << 17)]
                nxt = self.next[fv]
                r, c = np.nonzero((nxt >= 0) & ~seen[fq[:, None], nxt])
                code = np.unique(fq[r] * n + nxt[r, c])
                qq, vv = code // n, code % n
                seen[qq, vv] = True
                near = np.einsum("ij,ij->i", x[vv], q[qq]) >= least - SLACK
                new_q.append(qq[near])
                new_v.append(vv[near])
            front = (np.concatenate(new_q), np.concatenate(new_v))
            pairs.append(front)
        return tuple(np.concatenate(p) for p in zip(*pairs, strict=True))


def _smallest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges to the smallest node of each component of these pairs: as many as nodes, whatever the pairs."""
    nodes, code = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y, label = code[: len(a)], code[len(a) :], np.arange(len(nodes))
    while True:
        low = label.copy()
        np.minimum.at(low, x, label[y])
        np.minimum.at(low, y, label[x])
        low = low[low]
        if (low == label).all():
            return nodes, nodes[label]
        label = low


def _common(a: list, b: list, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many cells of a[i] are cells of b[j], a pair at a time."""
    padded = []
    for lists, filler in ((a, -1), (b, -2)):
        wide = np.full((len(lists), max(map(len, lists))), filler)
        for row, own in zip(wide, lists, strict=True):
            row[: len(own)] = own
        padded.append(wide)
    out = np.zeros(len(i), np.int64)
    for x in padded[0].T:
        for y in padded[1].T:
            out += (x[i] == y[j]) & (x[i] >= 0)
    return out


def _all_pairs(indexed: np.ndarray, q: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, place) of all pairs in range, which a cell of MOST vectors and a batch of queries are small enough for."""
    return np.nonzero(q @ indexed.T >= least - 1e-9)


def _links(rows: pa.Table, width: int, least: float, overlap: int) -> pa.Table:
    """What the queries among the rows find among the indexed ones: counts, hits that other cells may find too, and edges. All pairs are
    compared if there is no ``overlap``."""
    out_id, out_n, out_near, out_several, out_a, out_b = [], [], [], [], [], []
    rows = rows.sort_by([("order", "ascending"), ("rep", "ascending")])
    cell, asked = rows.filter(rows["indexed"]), rows.filter(rows["asked"])
    if len(cell) and len(asked):
        ids, copies, homes = cell["rep"].to_numpy(), cell["copies"].to_numpy(), cell["cells"].to_pylist()
        exact_rows = _unit(dense(cell["e"], width))
        graph = _Cell(exact_rows, overlap) if overlap else None
        q_ids, q_unit, q_homes = asked["rep"].to_numpy(), _unit(dense(asked["e"], width)), asked["cells"].to_pylist()
        for a in range(0, len(q_ids), BATCH):
            part = q_unit[a : a + BATCH]
            qi, vi = graph.search(part.astype(np.float32), least) if graph else _all_pairs(exact_rows, part, least)
            exact = np.concatenate([np.einsum("ij,ij->i", part[qi[k : k + PAIRS]], exact_rows[vi[k : k + PAIRS]]) >= least for k in range(0, len(qi), PAIRS)] or [np.zeros(0, bool)])
            qi, vi = qi[exact], vi[exact]
            apart = q_ids[a + qi] != ids[vi]
            qi, vi = qi[apart], vi[apart]
            if len(qi):
                edges = _smallest(q_ids[a + qi], ids[vi])
                out_a.append(edges[0])
                out_b.append(edges[1])
            several = _common(q_homes[a : a + BATCH], homes, qi, vi) > 1
            once, again = ~several, np.flatnonzero(several)
            again = again[np.argsort(qi[again], kind="stable")]
            pairs = np.stack((ids[vi[again]], copies[vi[again]]), axis=1).astype(np.int64)
            ends = np.searchsorted(qi[again], np.arange(len(part) + 1))
            out_several += [pairs[x:y].tobytes() if y > x else None for x, y in zip(ends[:-1], ends[1:], strict=True)]
            out_id.append(q_ids[a : a + BATCH])
            out_n.append(np.bincount(qi[once], copies[vi[once]], len(part)).astype(np.int64))
            out_near.append(np.bincount(qi[once], minlength=len(part)).astype(np.int64))
    none = np.zeros(0, np.int64)
    ids, n, near, a, b = (np.concatenate(v) if v else none for v in (out_id, out_n, out_near, out_a, out_b))
    own = a != b
    if own.any():
        a, b = _smallest(a[own], b[own])
        a, b = a[a != b], b[a != b]
    else:
        a = b = none
    blank = lambda k: pa.nulls(k, pa.int64())
    counts = {c: pa.chunked_array([pa.array(v), blank(len(a))]) for c, v in (("n", n), ("near", near))}
    several = pa.chunked_array([pa.array(out_several, pa.binary()), pa.nulls(len(a), pa.binary())])
    return pa.table({"rep": pa.chunked_array([pa.array(ids), pa.array(a)]), **counts, "several": several, "to": pa.chunked_array([blank(len(ids)), pa.array(b)])})


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the hits that several cells may have found, each once."""
    for batch in batches:
        n, near = [], []
        for packed in batch.column(1).to_pylist():
            pairs = np.frombuffer(b"".join(packed), np.int64).reshape(-1, 2)
            _, first = np.unique(pairs[:, 0], return_index=True)
            n.append(int(pairs[first, 1].sum()))
            near.append(len(first))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(near, pa.int64())], ["rep", "n", "near"])


def _sampled(size, most: int):
    """Rows that a bounded sample of ``most`` of ``size`` takes, by a hash."""
    part = (F.shiftright(F.xxhash64("e"), 11) + F.lit(1 << 52)) / float(1 << 53)  # 0 to 1
    return part * size < most


def _reaching(reps: DataFrame, centres: np.ndarray, width: int, least: float) -> DataFrame:
    """(e, rep, copies, cells, home): each node with the cell of its nearest centroid, where it is indexed, and all cells that may hold a
    vector in its range: those whose centroid is no farther off than the range and the widest angle of a member together."""
    sent = reps.sparkSession.sparkContext.broadcast(centres)

    def angles(column: pa.Array) -> np.ndarray:
        return np.arccos(np.clip(_unit(dense(column, width)) @ (_unit(sent.value.astype(np.float64)) if sent.value.any() else sent.value).T, -1, 1))

    def widest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = np.full(len(sent.value), -1.0)
        for batch in batches:
            far = angles(batch.column(0))
            np.maximum.at(most, far.argmin(axis=1), far.min(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(most))), pa.array(most)], ["cell", "radius"])

    radii = np.full(len(centres), -1.0)
    for r in reps.select("e").mapInArrow(widest, "cell long, radius double").groupBy("cell").agg(F.max("radius")).collect():  # CENTRES rows
        radii[r[0]] = r[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = angles(batch.column(0))
            home = far.argmin(axis=1)
            near = (far <= radii + np.arccos(min(1.0, max(-1.0, least))) + 1e-6) & (radii >= 0)
            near[np.arange(len(home)), home] = True
            cells = np.split(np.nonzero(near)[1], np.cumsum(near.sum(axis=1))[:-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tolist() for c in cells], pa.list_(pa.int64())), pa.array(home)], ["e", "rep", "copies", "cells", "home"])

    return cut(reps.select("e", "rep", "copies").mapInArrow(assign, "e array<double>, rep long, copies long, cells array<long>, home long"))


def _placed(reps: DataFrame, n: int, width: int, least: float, overlap: int, most_sample: int) -> DataFrame:
    """(e, rep, copies, cells array<long>): each node with the cells that it is in.

    Centroids are learned on a bounded sample, one for about CELL nodes, CENTRES at most; a node is in the cells of its ``overlap``
    nearest. Cells that are still large are split in the same way by centroids of their own, as often as LEVELS. Centroids in range
    of another are left out. No ``overlap`` places nodes as _reaching does.
    """

    def fit(group: pa.Table) -> pa.Table:
        group = group.sort_by("order")
        size = group["size"][0].as_py()
        c = _apart(_fit(_unit(dense(group["e"], width)), min(CENTRES, max(1, -(-max(1, overlap) * size // CELL)))), least, overlap)
        return pa.table({"cell": group["cell"][:1], "centres": pa.array([c.tobytes()], pa.binary())})

    first = reps.filter(_sampled(F.lit(n), most_sample)).select(F.xxhash64("e", F.lit(5)).alias("order"), "e", F.lit(0).cast("long").alias("cell"), F.lit(n).cast("long").alias("size"))
    got = first.groupBy("cell").applyInArrow(fit, "cell long, centres binary").collect()  # of one cell, CENTRES rows of width at most
    top = np.frombuffer(bytes(got[0].centres), np.float32).reshape(-1, width) if got else np.zeros((1, width), np.float32)
    if not overlap:
        return _reaching(reps, top, width, least)
    sent = reps.sparkSession.sparkContext.broadcast(top)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = _nearest(_unit(dense(batch.column(0), width)), sent.value, overlap)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells.tolist(), pa.list_(pa.int64()))], ["e", "rep", "copies", "cells"])

    placed = cut(reps.select("e", "rep", "copies").mapInArrow(assign, "e array<double>, rep long, copies long, cells array<long>"))

    def divide(members: pa.Table, centres: pa.Table) -> pa.Table:
        c = np.frombuffer(centres["centres"][0].as_py(), np.float32).reshape(-1, width) if len(centres) else np.zeros((1, width), np.float32)
        near = _nearest(_unit(dense(members["e"], width)), c, overlap).astype(np.uint64)
        cell = members["cell"].to_numpy().astype(np.uint64)[:, None]
        names = (mix(cell * np.uint64(CENTRES) + near) >> np.uint64(1)).astype(np.int64)
        return pa.table({"rep": members["rep"], "cells": pa.array(names.tolist(), pa.list_(pa.int64()))})

    before = None
    for _ in range(LEVELS):
        each = placed.select("e", "rep", F.explode("cells").alias("cell"))
        sizes = cut(each.groupBy("cell").agg(F.count("*").alias("size"), F.count("*").alias("weight")))
        left = sizes.filter(F.col("size") > SPLIT).agg(F.sum("size")).first()[0] or 0
        if not left or before is not None and left > 0.9 * before:
            break
        before = left
        inside = spread_join(each, sizes, "cell", "weight")
        large = inside.filter(F.col("size") > SPLIT).withColumn("slice", F.pmod(F.xxhash64("e", F.lit(3)), F.ceil(F.col("size") / MOST)))
        centres = large.filter(_sampled(F.col("size"), most_sample)).select(F.xxhash64("e", F.lit(5)).alias("order"), "e", "cell", "size").groupBy("cell").applyInArrow(fit, "cell long, centres binary")
        slices = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / MOST) - 1))
        centres = centres.join(sizes.filter(F.col("size") > SPLIT), "cell").select("cell", slices.alias("slice"), "centres")
        children = large.select("e", "rep", "cell", "slice").groupBy("cell", "slice").cogroup(centres.groupBy("cell", "slice")).applyInArrow(divide, "rep long, cells array<long>")
        done = inside.filter(F.col("size") <= SPLIT).select("rep", F.array("cell").alias("cells"))
        cells = done.unionAll(children).groupBy("rep").agg(F.flatten(F.collect_list("cells")).alias("cells"))  # a few a node
        placed = cut(placed.drop("cells").join(cells, "rep").select("e", "rep", "copies", "cells"))
    return placed


def near_links(vectors: DataFrame, least: float = 0.95, overlap: int = 2, most_sample: int = 16_384) -> DataFrame:
    """(vec_id long, n_links long, component_id long, n_near long), one row per row of ``vectors`` with a vec_id.

    Two vectors link at a cosine of ``least`` or more in double precision; vectors that are null, zero or hold null or
    non-finite components link with nothing. Shorter vectors count as if they ended in zeros. Equal vectors are one node with
    a number of copies; different vectors are different nodes, whatever their ids. Nodes go to overlapping cells (_placed), and within a cell to overlapping shards. Each shard builds a
    robust-pruned graph; a node's lists from its shards are united; all members of the cell are searched for in it, greedily from
    the medoids and then outwards while neighbours are in range, and hits are verified. A cell that no centroids divide is dealt
    into slices of MOST nodes, and all pairs of slices are searched. A task sends counts and one edge a node; only hits that the
    query may meet in a further cell are sent themselves, packed a query, and counted once. ``n_near`` counts the other distinct
    vectors in range, n_links all rows. An ``overlap`` of 0 is the exact way: a node is indexed in one cell, asks in all cells whose
    centroid and radius allow a link, and all pairs there are compared. An empty table gives no rows.
    """
    rows = cut(usable(vectors))
    reps = cut(rows.groupBy("e").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies")).withColumn("rep", F.monotonically_increasing_id()))
    n, width = reps.agg(F.count("*"), F.max(F.size("e"))).first()
    own_id = F.col("vec_id").cast("long").alias("vec_id")
    if not n:
        return vectors.filter("vec_id is not null").select(own_id, F.lit(0).cast("long").alias("n_links"), own_id.alias("component_id"), F.lit(0).cast("long").alias("n_near"))
    most = max(1, min(MOST, COMPONENTS // width))
    placed = _placed(reps, n, width, least, overlap, max(1, min(most_sample, COMPONENTS // width)))
    indexed = F.lit(True) if overlap else F.col("cell") == F.col("home")
    members = placed.withColumn("cell", F.explode("cells")).select("e", "rep", "copies", F.col("cells") if overlap else F.array("home").alias("cells"), "cell", F.xxhash64("e", F.lit(5)).alias("order"), indexed.alias("lives"))
    sizes = cut(members.groupBy("cell").agg(F.ceil(F.count("*") / most).alias("parts"), F.count("*").alias("weight")))
    dealt = spread_join(members, sizes, "cell", "weight").withColumn("own", F.pmod("order", "parts"))
    # A slice is indexed beside the queries of every slice, and asks in every slice; most cells have one.
    every = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    place = lambda p, t, i, q: F.struct(p.alias("p"), t.alias("t"), F.lit(i).alias("indexed"), F.lit(q).alias("asked"))
    others = F.filter(every, lambda k: k != F.col("own"))
    asks = F.transform(others, lambda k: place(k, F.col("own"), False, True))
    seats = F.when(F.col("lives"), F.concat(F.array(place(F.col("own"), F.col("own"), True, True)), F.transform(others, lambda k: place(F.col("own"), k, True, False)), asks))
    seats = seats.otherwise(F.concat(F.array(place(F.col("own"), F.col("own"), False, True)), asks))
    seated = dealt.withColumn("seat", F.explode(seats)).select("cell", "seat.*", "rep", "copies", "e", "cells", "order")
    found = cut(seated.groupBy("cell", "p", "t").applyInArrow(lambda group: _links(group, width, least, overlap), "rep long, n long, near long, several binary, to long"))
    again = found.filter("several is not null").groupBy("rep").agg(F.collect_list("several").alias("several")).mapInArrow(_settle, "rep long, n long, near long")
    counts = found.filter("n is not null").select("rep", "n", "near").unionAll(again).groupBy("rep").agg(F.sum("n").alias("n"), F.sum("near").alias("n_near"))
    roots = connected_components(found.filter("to is not null").select(F.col("rep").alias("src"), F.col("to").alias("dst")))
    # A component is named by its smallest vec_id: one row a component, met by its nodes where they are if it is large.
    inside = cut(roots.withColumnRenamed("node", "rep").join(reps.select("rep", "low"), "rep"))
    named = spread_join(inside.select("rep", "component"), inside.groupBy("component").agg(F.min("low").alias("name"), F.count("*").alias("copies")), "component")
    nodes = reps.join(counts, "rep", "left").join(named.select("rep", "name"), "rep", "left")
    nodes = cut(nodes.select("e", "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("name", "low").alias("component_id"), F.coalesce("n_near", F.lit(0)).alias("n_near")))
    linked = spread_join(rows, nodes, "e").select("vec_id", "n_links", "component_id", "n_near")
    alone = vectors.select(own_id, F.col("embedding").cast("array<double>").alias("e")).filter("vec_id is not null")
    odd = F.col("e").isNull() | F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists("e", lambda x: F.coalesce(x, F.lit(0.0)) != 0)
    return linked.unionAll(alone.filter(odd).select("vec_id", F.lit(0).cast("long"), F.col("vec_id"), F.lit(0).cast("long")))


def audit(vectors: DataFrame, links: DataFrame, least: float = 0.95, queries: int = 256) -> float:
    """Recall of n_near against brute force over all distinct vectors; copies are left out, so they hide nothing.

    The queries are distinct vectors with the smallest hashes: ``queries`` of all and as many of those with neighbours found. A
    query's recall is the smaller count over the larger, so that counting twice is seen too; the result is the smaller mean of both choices, over queries with a neighbour. Ids that name several vectors are not asked.
    """
    reps = cut(usable(vectors).groupBy("e").agg(F.min("vec_id").alias("rep")))
    one = reps.groupBy("rep").agg(F.count("*").alias("vectors")).filter("vectors = 1").select("rep")
    own = links.groupBy(F.col("vec_id").alias("rep")).agg(F.min("n_near").alias("n"), F.max("n_near").alias("most")).filter("n = most").drop("most").join(one, "rep")
    known = reps.join(own, "rep").withColumn("hash", F.xxhash64("rep", F.lit(11)))
    chosen = [known.filter(f).orderBy("hash", "rep").limit(queries).collect() for f in ("true", "n > 0")]
    picked = list({r.rep: r for part in chosen for r in part}.values())
    if not picked:
        return 1.0
    width = reps.agg(F.max(F.size("e"))).first()[0]
    q = np.zeros((len(picked), width))
    for i, r in enumerate(picked):
        q[i, : len(r.e)] = r.e
    ids, q = np.array([r.rep for r in picked]), _unit(q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            near = (_unit(dense(batch.column(0), width)) @ q.T >= least) & (batch.column(1).to_numpy()[:, None] != ids)
            total += near.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], ["rep", "n"])

    truth = {r[0]: r[1] for r in reps.select("e", "rep").mapInArrow(run, "rep long, n long").groupBy("rep").agg(F.sum("n")).collect()}
    recall = lambda r: min(r.n, truth[r.rep]) / max(r.n, truth[r.rep])
    means = [np.mean(part) for part in ([recall(r) for r in c if r.n or truth[r.rep]] for c in chosen) if part]
    return float(min(means, default=1.0))


def near_duplicates(vectors: DataFrame, least: float = 0.95, least_recall: float = 0.9, **how) -> DataFrame:
    """near_links with the audit's figure as a column ``recall``, the same in all rows; where it is under ``least_recall``, cells and shards
    overlap more, and at last all cells that may hold links are compared whole. The rest, nulls and repeated rows included, is as there."""
    for overlap in (2, 4, 0):
        links = cut(near_links(vectors, least, overlap=overlap, **how))
        recall = audit(vectors, links, least)
        logging.getLogger(__name__).info("recall of links with overlap %d: %.4f", overlap, recall)
        if recall >= least_recall:
            break
    return links.withColumn("recall", F.lit(recall))
