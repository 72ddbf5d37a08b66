"""Packing tokenised documents into sequences of fixed length by cutting-stock column generation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayloom.llm.bpe import Bpe
from assayloom.llm.common import chunks, cut, pick
from assayloom.llm.cutting import whole_patterns

#: Remainders are grouped by this step; the program then has half as many rows, and padding grows by half a token a piece.
STEP = 2
#: A row's number has the partition above these bits and the place in it below.
PART_BITS = 33


NUMBERED = "doc_id long, n_tokens long, ids binary, part long, uid long, size long, own long, fulls long"


def _numbered(docs: DataFrame, capacity: int, tokenizer: str | None, end_id: int) -> DataFrame:
    """The ids of each whole text and then ``end_id``, as little-endian 16-bit integers (32-bit for a vocabulary over 65,536), with the
    row's partition and number, the size class of its remainder, and what went before it in the partition: rows of that class (own)
    and full sequences (fulls). A null text is an empty one. A task that is run again counts the same way; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part = Bpe.of(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], bpe.kind).tobytes()
        rows, fulls, seen = part << PART_BITS, 0, np.zeros(capacity // STEP + 1, np.int64)
        for batch, texts in chunks(batches, most=1 << 20):
            found = bpe.encode([(t or b"").decode("utf-8", "replace") for t in texts])
            n, ids = np.array([len(x) + 1 for x in found], np.int64), [x.tobytes() + end for x in found]
            full, size = n // capacity, (n % capacity + STEP - 1) // STEP
            order, count = np.argsort(size, kind="stable"), np.bincount(size, minlength=len(seen))
            own = np.zeros(len(n), np.int64)
            own[order] = np.arange(len(n)) - np.repeat(np.cumsum(count) - count, count) + seen[size[order]]
            before = fulls + np.cumsum(full) - full
            columns = [np.full(len(n), part), rows + np.arange(len(n)), size, own, before]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(ids, pa.binary()), *map(pa.array, columns)], names)
            rows, fulls, seen = rows + len(n), fulls + int(full.sum()), seen + count

    names = [c.split()[0] for c in NUMBERED.split(", ")]
    return pick(docs, doc_id="long", text="string").mapInArrow(run, NUMBERED)


class _Slots:
    """Which sequence and place a rank of a size class gets; ranks past the patterns get none."""

    def __init__(self, patterns: list[tuple[dict[int, int], int]]):
        self.sequences, by = 0, {}
        for p, times in patterns:
            place = 0
            for s, k in sorted(p.items(), reverse=True):
                starts, rows = by.setdefault(s, ([0], []))
                rows.append((k, self.sequences, place))
                starts.append(starts[-1] + k * times)
                place += k
            self.sequences += times
        self.by = {s: (np.array(starts), np.array(rows)) for s, (starts, rows) in by.items()}

    def place(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seq, slot = np.full(len(rank), -1), np.zeros(len(rank), np.int64)
        for s in np.unique(size):
            if s in self.by:
                starts, rows = self.by[s]
                own = np.flatnonzero((size == s) & (rank < starts[-1]))
                j = np.searchsorted(starts, rank[own], "right") - 1
                t = rank[own] - starts[j]
                seq[own], slot[own] = rows[j, 1] + t // rows[j, 0], rows[j, 2] + t % rows[j, 0]
        return seq, slot


def pack(docs: DataFrame, capacity: int = 1024, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """Pieces of all documents in sequences of at most ``capacity`` tokens:
    (doc_id long, start long, length long, ids binary of little-endian 32-bit ids, doc_tokens long, sequence_id long, offset long).

    Each document is cut into full sequences and a remainder. The histogram of remainders (at most capacity / 2 classes,
    whatever the input) is what the driver gets; column generation finds patterns of classes that fill a sequence, and
    documents take the patterns' slots by their rank within their class. What rounding the patterns down leaves, fewer tokens
    than ``capacity`` times the classes, is laid end to end and cut where a sequence is full, so only the last of those
    sequences has room left. Rows that repeat are documents of their own; a null or empty text is the end id alone; an empty
    table gives no pieces. Token ids are computed once and kept in the shared folder under a row number of their own.
    """
    if capacity % STEP:
        raise ValueError(f"the capacity is a multiple of {STEP}")
    tokens = cut(_numbered(docs, capacity, tokenizer, end_id))
    rows = tokens.select("uid", "part", (F.col("n_tokens") % capacity).alias("rest"), "size", "own", F.expr(f"n_tokens div {capacity}").alias("full"))
    counts = cut(rows.groupBy("part", "size").agg(F.count("*").alias("n"), F.sum("full").alias("full")))
    demand = {r[0]: r[1] for r in counts.filter("size > 0").groupBy("size").agg(F.sum("n")).collect()}
    slots = _Slots(whole_patterns(demand, capacity // STEP)[0])
    sent = docs.sparkSession.sparkContext.broadcast(slots)  # as many entries as sizes in the patterns

    # Ranks: a count of the parts before, then the place within the part; the window has a row a part.
    before = counts.select("part", "size", (F.sum("n").over(Window.partitionBy("size").orderBy("part")) - F.col("n")).alias("before"))
    ranked = rows.filter("size > 0").join(before, ["part", "size"]).select("uid", "rest", "size", (F.col("before") + F.col("own")).alias("rank"))

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seq, slot = sent.value.place(batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(seq, pa.int64()), pa.array(slot, pa.int64())], ["uid", "rest", "seq", "slot"])

    seated = cut(ranked.mapInArrow(seat, "uid long, rest long, seq long, slot long"))
    in_patterns = seated.filter("seq >= 0").select("uid", "seq", (F.sum("rest").over(Window.partitionBy("seq").orderBy("slot")) - F.col("rest")).alias("offset"))
    # At most capacity times the classes tokens, whatever the input: one task is enough.
    stream = seated.filter("seq < 0").select("uid", (F.sum("rest").over(Window.partitionBy(F.lit(0)).orderBy("uid")) - F.col("rest")).alias("at"))
    stream = stream.select("uid", (F.expr(f"at div {capacity}") + slots.sequences).alias("seq"), (F.col("at") % capacity).alias("offset"))
    left = seated.filter("seq < 0").agg(F.sum("rest")).first()[0] or 0
    base = slots.sequences + -(-left // capacity)
    parts = counts.groupBy("part").agg(F.sum("full").alias("full"))
    parts = parts.select("part", (F.sum("full").over(Window.partitionBy(F.lit(0)).orderBy("part")) - F.col("full") + base).alias("base"))  # a row a partition
    places = in_patterns.unionByName(stream)

    def slice_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = Bpe.of(tokenizer).kind
        for batch in batches:
            cols, rest = [[] for _ in range(7)], batch.to_pydict()
            for doc, n, raw, seq, offset, first in zip(*(rest[c] for c in ("doc_id", "n_tokens", "ids", "seq", "offset", "first")), strict=True):
                ids = np.frombuffer(raw, kind).astype("<u4")
                cuts = [(k * capacity, capacity, first + k, 0) for k in range(n // capacity)]
                if tail := n % capacity:
                    fit = min(tail, capacity - offset)
                    cuts.append((n - tail, fit, seq, offset))
                    if fit < tail:
                        cuts.append((n - tail + fit, tail - fit, seq + 1, 0))
                for start, length, s, o in cuts:
                    for c, v in zip(cols, (doc, start, length, ids[start : start + length].tobytes(), n, s, o), strict=True):
                        c.append(v)
                if len(cols[0]) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)
                    cols = [[] for _ in range(7)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    types = [pa.binary() if c == "ids" else pa.int64() for c in names]
    met = tokens.join(F.broadcast(parts), "part").withColumn("first", F.col("base") + F.col("fulls"))  # a row a partition is sent
    return met.join(places, "uid", "left").select("doc_id", "n_tokens", "ids", "seq", "offset", "first").mapInArrow(slice_up, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
