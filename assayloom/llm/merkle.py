"""A Merkle tree over a dataset: for every row the digests that lead from its own to the root, found in aligned blocks."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayloom.llm.common import cut, tidy

#: What a leaf is made of, in this order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes of a block at most; it holds as many levels of the tree as that allows, and is one row with its digests.
BLOCK = 1024
#: Rows of a partition of the sorted leaves.
PART_ROWS = 1 << 18
#: Bytes of a digest as text, and as it is kept.
HEX, RAW = 64, 32


class _Tree(NamedTuple):
    """How many nodes have one above, how many levels a block holds, and its nodes."""

    fanout: int
    levels: int
    width: int


def _leaf(values: dict[str, Column]) -> Column:
    """The digest of a row: each value as its number of bytes, a colon and itself, or as a dash where it is null."""
    parts = (F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in (c.cast("string") for c in values.values()))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _digest(data: bytes) -> bytes:
    return sha256(data).hexdigest().encode()


def _matrix(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint8).reshape(-1, HEX)


def _hex(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw.hex().encode(), np.uint8).reshape(-1, HEX)


def _climb(level: np.ndarray, tree: _Tree, block: int) -> list[np.ndarray]:
    """The levels of a block from its nodes on: a matrix of digests each, a row a node. A block that is the whole of its source ends
    with one node, any other after all its levels, when its single node stands where the tree's own has it."""
    levels, fanout = [level], tree.fanout
    alone = block == 0 and len(level) < tree.width
    while len(levels) <= tree.levels and not (alone and len(levels[-1]) == 1):
        level = levels[-1]
        whole = len(level) // fanout * fanout
        runs = level[:whole].reshape(-1, fanout * HEX)
        up = [_digest(r.data) for r in runs]
        levels.append(_matrix(up if whole == len(level) else [*up, _digest(level[whole:].tobytes())]))
    return levels


def _siblings(levels: list[np.ndarray], fanout: int) -> tuple[pa.Array, np.ndarray]:
    """For every node of the lowest level the others of its run, level by level, as one binary value, and (place, size) in its run of
    each level as bytes. A node's run starts at the multiple of the fanout below it, so all are found by index."""
    at, found, there, turns = np.arange(len(levels[0])), [], [], []
    for level in levels[:-1]:
        first = at // fanout * fanout
        size, place = np.minimum(fanout, len(level) - first), at - first
        slots = np.arange(fanout - 1) + (np.arange(fanout - 1) >= place[:, None])
        there.append(slots < size[:, None])
        found.append(level[np.minimum(first[:, None] + slots, len(level) - 1)])
        turns.append(np.stack((place, size), axis=1).astype(np.uint8))
        at = at // fanout
    if not found:
        return pa.array([b""] * len(levels[0]), pa.binary()), np.zeros((len(levels[0]), 0), np.uint8)
    real = np.concatenate(there, axis=1)
    data = np.concatenate(found, axis=1)[real]
    ends = np.concatenate(([0], np.cumsum(real.sum(axis=1) * HEX))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(real), [None, pa.py_buffer(ends), pa.py_buffer(data)]), np.concatenate(turns, axis=1)


def fold(leaf: bytes, siblings: bytes, turns: bytes) -> bytes:
    """The root that a leaf (64 hexadecimal digits) leads to with these siblings; ``turns`` has its place and the run's size of each level."""
    at = 0
    for place, size in zip(turns[::2], turns[1::2], strict=True):
        mine, end = at + HEX * place, at + HEX * (size - 1)
        leaf = _digest(siblings[at:mine] + leaf + siblings[mine:end])
        at = end
    return leaf


def _sorted_blocks(rows: DataFrame, order: list[str], width: int) -> DataFrame:
    """(source, block, pieces): the rows (source, id, leaf, claim) of each source in ``order``, as blocks of ``width`` nodes.

    Rows are dealt out by ranges of (source, order), so a source of any size is shared by many tasks. Each task packs what it has;
    only where a range goes on with the source of the one before does it need a number from outside, so one row a task
    reaches the driver. Pieces of a block, two where a border cuts it, then meet.
    """
    by = [F.asc_nulls_first(c) for c in ("source", *order)]
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // PART_ROWS))
    ids = dict(rows.dtypes)["id"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, run, at, last = TaskContext.get().partitionId(), -1, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            runs = pc.run_end_encode(batch.column("source"))
            out, start = [], 0
            for source, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                if run < 0 or source != last:
                    run, at, last = run + 1, 0, source
                for a in range(start, end, width):
                    n = min(width, end - a)
                    raw = (b"".join(batch.column(c).slice(a, n).to_pylist()) for c in ("leaf", "claim"))
                    out.append((part, run, source, at, n, batch.column("id").slice(a, n).to_pylist(), *raw))
                    at += n
                start = end
            for a in range(0, len(out), 256):
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out[a : a + 256], strict=True), kinds, strict=True)], names)

    id_type = pa.string() if ids == "string" else pa.int64()
    names, kinds = ["part", "run", "source", "at", "n", "ids", "leaves", "claims"], [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(id_type), pa.binary(), pa.binary()]
    dealt = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).select("source", "id", "leaf", "claim")
    packed = cut(dealt.mapInArrow(pack, f"part long, run long, source string, at long, n long, ids array<{ids}>, leaves binary, claims binary"))
    runs = packed.groupBy("part", "run").agg(F.first("source").alias("source"), F.sum("n").alias("n"))
    ends = runs.groupBy("part").agg(*(f(F.struct("source", "n", "run"), "run").alias(c) for f, c in ((F.min_by, "head"), (F.max_by, "tail"))))
    before, tail, so_far = {}, None, 0
    for r in sorted(ends.collect()):  # one row a task
        before[r.part] = so_far if tail is not None and tail[0] == r.head.source else 0
        so_far = r.tail.n + (before[r.part] if r.tail.run == r.head.run else 0)
        tail = (r.tail.source,)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for part, run, source, at, n, own, leaves, claims in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at, a = at + (0 if run else before[part]), 0
                while a < n:
                    b = min(n, a + width - (at + a) % width)
                    out.append((source, (at + a) // width, (at + a) % width, own[a:b], leaves[a * RAW : b * RAW], claims[a * RAW : b * RAW]))
                    a = b
            if out:
                types = [pa.string(), pa.int64(), pa.int64(), pa.list_(id_type), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), types, strict=True)], ["source", "block", "start", "ids", "leaves", "claims"])

    pieces = packed.mapInArrow(align, f"source string, block long, start long, ids array<{ids}>, leaves binary, claims binary")
    return cut(pieces.groupBy("source", "block").agg(F.array_sort(F.collect_list(F.struct("start", "ids", "leaves", "claims"))).alias("pieces")))


def _tops(blocks: DataFrame, tree: _Tree) -> DataFrame:
    """(source, pos, leaf): the single node of each block of ``blocks`` (source, block, pieces)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops = []
            for block, pieces in zip(batch.column("block").to_pylist(), batch.column("pieces").to_pylist(), strict=True):
                nodes = _hex(b"".join(p["leaves"] for p in pieces))
                tops.append(bytes.fromhex(_climb(nodes, tree, block)[-1].tobytes().decode()))
            yield pa.RecordBatch.from_arrays([batch.column("source"), batch.column("block"), pa.array(tops, pa.binary())], ["source", "pos", "leaf"])

    return cut(blocks.mapInArrow(run, "source string, pos long, leaf binary"))


def _above(blocks: DataFrame, paths: DataFrame, tree: _Tree) -> DataFrame:
    """(source, pos, siblings, turns, subroot, root) of the nodes of ``blocks`` from those of the blocks' own nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for source, block, pieces, siblings, turns, subroot, root in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                nodes = _hex(b"".join(p["leaves"] for p in pieces))
                own, moves = _siblings(_climb(nodes, tree, block), tree.fanout)
                out += [(source, block * tree.width + k, s + siblings, m.tobytes() + turns, subroot, root) for k, (s, m) in enumerate(zip(own.to_pylist(), moves, strict=True))]
            if out:
                types = [pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), types, strict=True)], ["source", "pos", "siblings", "turns", "subroot", "root"])

    return _met(blocks, paths).mapInArrow(run, "source string, pos long, siblings binary, turns binary, subroot string, root string")


def _met(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    """Blocks beside the paths of their own nodes; the source that is null meets itself."""
    p = paths.withColumnRenamed("source", "of")
    return blocks.join(p, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("pos"))).select("source", "block", "pieces", "siblings", "turns", "subroot", "root")


def _levels(leaves: DataFrame, tree: _Tree) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of every ``width``-fold level, from the lowest on, and (source, pos, leaf) of the last one's nodes, one a source."""
    rounds = [leaves]
    while True:
        tops = _tops(rounds[-1], tree)
        if not tops.agg(F.max("pos")).first()[0]:
            return rounds, tops
        piece = F.struct((F.col("pos") % tree.width).alias("start"), F.col("leaf").alias("leaves"))
        rounds.append(cut(tops.groupBy("source", F.floor(F.col("pos") / tree.width).alias("block")).agg(F.array_sort(F.collect_list(piece)).alias("pieces"))))


def manifest(docs: DataFrame, claims: dict[str, Column] | None = None, fanout: int = 3) -> DataFrame:
    """(doc_id long, source, position long, leaf, siblings binary, turns binary, subroot, root, claim, folded), one row per row of ``docs``;
    digests are 64 hexadecimal digits.

    A row's leaf is the digest of its COLUMNS. Leaves of a source ascend by doc_id (null first; rows repeating an id by leaf, and equal
    rows in any order), every ``fanout`` consecutive nodes have one digest above, up to the source's subroot; the subroots by source
    (null first, UTF-8 order) likewise up to the root. ``siblings`` are the other nodes of a leaf's runs in order up to the root,
    ``turns`` its places there. ``claims`` maps columns to what someone else's copy of the row says: ``claim`` is the leaf of that, and
    ``folded`` the root it leads to with the siblings, equal to ``root`` only if the copy is the row itself. Without claims
    the rows prove themselves. A null value is a dash in its leaf, an empty text has 0 bytes. Further columns are left alone. An empty table gives
    no rows.

    Texts are digested where they are, by built-in functions; what is shuffled are digests, in blocks of at most BLOCK nodes.
    """
    if not 2 <= fanout <= 32:
        raise ValueError("the fanout is 2 to 32")
    levels = max(k for k in range(1, 11) if fanout**k <= BLOCK)
    tree = _Tree(fanout, levels, fanout**levels)
    kinds = {c: F.col(f"`{c}`").cast("long" if c in ("doc_id", "n_chars") else "string") for c in COLUMNS}
    told = kinds | {c: v for c, v in (claims or {}).items()}
    rows = cut(docs.select(kinds["source"].alias("source"), kinds["doc_id"].alias("id"), _leaf(kinds).alias("leaf"), _leaf(told).alias("claim"), F.monotonically_increasing_id().alias("row")))
    rounds, subroots = _levels(_sorted_blocks(rows, ["id", "leaf", "row"], tree.width), tree)
    # The subroots are leaves of one more tree, with no source but an order by it.
    sources = subroots.select(F.lit(None).cast("string").alias("source"), F.col("source").alias("id"), "leaf", F.col("leaf").alias("claim"))
    upper, top = _levels(_sorted_blocks(sources, ["id"], tree.width), tree)
    root = F.lower(F.hex("leaf"))
    paths = top.select("source", "pos", F.lit(b"").alias("siblings"), F.lit(b"").alias("turns"), root.alias("subroot"), root.alias("root"))
    for blocks in upper[:0:-1]:
        paths = cut(_above(blocks, paths, tree))
    paths = _rows(upper[0], paths, tree, "string").select(F.col("id").alias("source"), F.lit(0).cast("long").alias("pos"), "siblings", "turns", F.col("leaf").alias("subroot"), "root")
    for blocks in rounds[:0:-1]:
        paths = cut(_above(blocks, paths, tree))
    return _rows(rounds[0], paths, tree, "long").withColumnRenamed("id", "doc_id")


def _rows(blocks: DataFrame, paths: DataFrame, tree: _Tree, ids: str) -> DataFrame:
    """All nodes of the lowest blocks with their paths, and the roots their claims fold to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, block, pieces, siblings, turns, subroot, root in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                nodes, claims = (_hex(b"".join(p[c] for p in pieces)) for c in ("leaves", "claims"))
                own, moves = _siblings(_climb(nodes, tree, block), tree.fanout)
                own, moves = [s + siblings for s in own.to_pylist()], [m.tobytes() + turns for m in moves]
                claims, n = [c.tobytes() for c in claims], len(nodes)
                folded = [fold(c, s, m) for c, s, m in zip(claims, own, moves, strict=True)]
                text = lambda v: pa.array(v, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i for p in pieces for i in p["ids"]], pa.string() if ids == "string" else pa.int64()), pa.array([source] * n, pa.string()), pa.array(np.arange(n) + block * tree.width, pa.int64()), text([x.tobytes() for x in nodes]),
                     pa.array(own, pa.binary()), pa.array(moves, pa.binary()), pa.array([subroot] * n, pa.string()), pa.array([root] * n, pa.string()), text(claims), text(folded)],
                    ["id", "source", "position", "leaf", "siblings", "turns", "subroot", "root", "claim", "folded"],
                )
        tidy()

    return _met(blocks, paths).mapInArrow(run, f"id {ids}, source string, position long, leaf string, siblings binary, turns binary, subroot string, root string, claim string, folded string")
