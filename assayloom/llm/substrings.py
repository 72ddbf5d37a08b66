"""Exact substring deduplication with difference-cover anchors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayloom.llm.common import HOT_KEYS, chunks, cut, dealt, run_hashes, tidy, word_hashes

#: Perfect difference sets by their period; every difference modulo the period occurs once.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27), 57: (0, 1, 3, 13, 32, 36, 43, 52)}
#: Items that one group of the shuffle holds; groups are as many as that takes.
GROUP_ITEMS = 1 << 20
#: Groups of small inputs; a document's places come back in a piece a group at most.
LEAST_GROUPS = 64
#: Text bytes whose items travel together; what repeats within them is known before the shuffle.
TOGETHER = 4 << 20

#: Bytes of an anchor's and a window's hash that travel. Anchors that collide only make more candidates; equal windows are those
#: with 96 equal bits.
ANCHOR_BYTES, WINDOW_BYTES = 6, 12

ITEMS = "bucket long, hashes binary, k1 binary, k2 binary, new binary, at binary, known binary"


def cover_for(length: int) -> tuple[int, tuple[int, ...]]:
    """The largest period whose anchors (length - period + 1 words) keep at least two fifths of a window; (1, (0,)) for short windows."""
    return max(((v, d) for v, d in COVERS.items() if 5 * (length - v + 1) >= 2 * length), default=(1, (0,)))


class _Batch:
    """Words of a slice of texts: their hashes and which text each belongs to."""

    def __init__(self, texts: list[bytes | None]):
        self.hashes, self.counts = word_hashes(texts)
        self.first = np.concatenate(([0], np.cumsum(self.counts)))
        self.doc = np.repeat(np.arange(len(texts)), self.counts)
        self.at = np.arange(len(self.doc)) - self.first[:-1][self.doc]  # the word's place in its text

    def fits(self, length: int) -> np.ndarray:
        return self.at + length <= self.counts[self.doc]

    def runs(self, at: np.ndarray, length: int, size: int) -> np.ndarray:
        """The first ``size`` bytes of the hashes of runs of words, a row a run."""
        lanes = [run_hashes(self.hashes[:, k], at, length) for k in range(-(-size // 8))]
        return np.stack(lanes, axis=1).view(np.uint8).reshape(len(at), 8 * len(lanes))[:, :size]


def _lanes(raw: np.ndarray) -> np.ndarray:
    """Bytes of hashes as 64-bit integers, a column eight bytes."""
    wide = np.zeros((len(raw), -(-raw.shape[1] // 8) * 8), np.uint8)
    wide[:, : raw.shape[1]] = raw
    return wide.view("<u8")


def _pack(hashes: np.ndarray, doc: np.ndarray, at: np.ndarray, k1: np.ndarray, k2: np.ndarray, buckets: int) -> pa.RecordBatch:
    """One row a bucket, its items in the order of documents: hash, whether a key starts, place in the text (16 bits where all of a
    row's fit, else 32), state.

    Of equal hashes one goes to their bucket, marked 1; the others, 2, are known to repeat and go to any bucket.
    """
    lanes = _lanes(hashes)
    order = np.argsort(lanes[:, 0], kind="stable")
    same = np.zeros(len(hashes), bool)
    same[1:] = (lanes[order[1:]] == lanes[order[:-1]]).all(axis=1)
    state = np.zeros(len(hashes), np.uint8)
    state[order[:-1][same[1:]]] = 1
    state[order[same]] = 2
    bucket = np.where(state < 2, lanes[:, 0] % np.uint64(buckets), (k2[doc].astype(np.uint64) + at.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    bucket = bucket[by]
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    rows: dict[str, list] = {c: [] for c in ("hashes", "k1", "k2", "new", "at", "known")}
    for part in np.split(by, cuts[1:]) if len(by) else []:
        own, places = doc[part], at[part]
        new = np.diff(own, prepend=-1) != 0
        keys = own[new]
        for c, v in (("hashes", hashes[part]), ("k1", k1[keys]), ("k2", k2[keys]), ("new", new), ("at", places.astype(np.uint16 if places.max() < 1 << 16 else np.uint32)), ("known", state[part])):
            rows[c].append(v.tobytes())
    return pa.RecordBatch.from_arrays([pa.array(bucket[cuts], pa.int64()), *(pa.array(v, pa.binary()) for v in rows.values())], ["bucket", *rows])


def _repeats(table: pa.Table) -> pa.Table:
    """Of a bucket's items, those whose hash occurs elsewhere too, by document."""
    rows = [table.column(c).to_pylist() for c in ("hashes", "k1", "k2", "new", "at", "known")]
    hashes, k1, k2, at, state = [], [], [], [], []
    for h, a, b, new, places, known in zip(*rows, strict=True):
        doc, n = np.cumsum(np.frombuffer(new, np.uint8).astype(np.int64)) - 1, len(new)
        hashes.append(_lanes(np.frombuffer(h, np.uint8).reshape(n, -1)))
        k1.append(np.frombuffer(a, np.int64)[doc])
        k2.append(np.frombuffer(b, np.int64)[doc])
        at.append(np.frombuffer(places, np.uint16 if len(places) == 2 * n else np.uint32).astype(np.int32))
        state.append(np.frombuffer(known, np.uint8))
    hashes, k1, k2, at, state = (np.concatenate(x) for x in (hashes, k1, k2, at, state))
    dup = state == 2
    own = np.flatnonzero(~dup)
    order = own[np.lexsort(hashes[own].T)]
    group = np.cumsum(np.concatenate(([False], (hashes[order[1:]] != hashes[order[:-1]]).any(axis=1))))
    dup[order] = (np.bincount(group, minlength=1)[group] > 1) | (state[order] == 1)
    k1, k2, at = k1[dup], k2[dup], at[dup]
    order = np.lexsort((at, k2, k1))
    k1, k2, at = k1[order], k2[order], at[order]
    once = np.ones(len(at), bool)  # rows repeated whole share a key and their places
    once[1:] = (np.diff(k1) != 0) | (np.diff(k2) != 0) | (np.diff(at) != 0)
    k1, k2, at = k1[once], k2[once], at[once]
    cuts = np.flatnonzero((np.diff(k1) != 0) | (np.diff(k2) != 0)) + 1
    first = np.concatenate(([0], cuts)) if len(at) else np.zeros(0, np.int64)
    tidy()
    return pa.table({"k1": k1[first], "k2": k2[first], "places": pa.array([x.tobytes() for x in np.split(at, cuts)] if len(at) else [], pa.binary())})


class _Gather:
    """Items of several slices, packed once their texts reach TOGETHER bytes or their number the room of a place."""

    def __init__(self, buckets: int):
        self.buckets, self.parts, self.size, self.docs = buckets, [], 0, 0

    def add(self, texts: list[bytes | None], hashes: np.ndarray, doc: np.ndarray, at: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> Iterator[pa.RecordBatch]:
        if self.docs + len(texts) > 1 << 16:
            yield from self.flush()
        self.parts.append((hashes, doc + self.docs, at, k1, k2))
        self.docs += len(texts)
        self.size += sum(len(t or b"") for t in texts)
        if self.size >= TOGETHER:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            yield _pack(*(np.concatenate(x) for x in zip(*self.parts, strict=True)), self.buckets)
        self.parts, self.size, self.docs = [], 0, 0


def _keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)


def _anchors(keyed: DataFrame, length: int, buckets: int, size: int) -> DataFrame:
    """(k1, k2, places binary): anchors, at cover positions only, that occur more than once anywhere."""
    period, cover = cover_for(length)
    member = np.isin(np.arange(period), cover)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gather = _Gather(buckets)
        for batch, texts in chunks(batches):
            k1, k2 = _keys(batch)
            b = _Batch(texts)
            at = np.flatnonzero(member[b.at % period] & b.fits(length - period + 1) & (b.counts[b.doc] >= length))
            yield from gather.add(texts, b.runs(at, length - period + 1, ANCHOR_BYTES), b.doc[at], b.at[at], k1, k2)
        yield from gather.flush()

    return dealt(keyed.mapInArrow(emit, ITEMS), ["bucket"], size).groupBy("bucket").applyInArrow(_repeats, "k1 long, k2 long, places binary")


def _merge(found: DataFrame) -> DataFrame:
    """One row a key with its places, each twice at most: where its hash belongs, and where those known to repeat are sent."""
    return found.groupBy("k1", "k2").agg(F.collect_list("places").alias("places"))


def _places(values: list | None) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(v) for v in values), np.int32).astype(np.int64) if values else np.zeros(0, np.int64)


def _windows(candidates: DataFrame, length: int, buckets: int, size: int) -> DataFrame:
    """(k1, k2, places binary): windows around repeated anchors, extended to full length, that start more than once anywhere."""
    period, _ = cover_for(length)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gather = _Gather(buckets)
        for batch, texts in chunks(batches):
            k1, k2 = _keys(batch)
            b = _Batch(texts)
            near = np.zeros(len(b.at) + 1, np.int64)  # a window holds an anchor up to period - 1 words after its start
            places, whole = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("places", "whole"))
            for i, (own, every) in enumerate(zip(places, whole, strict=True)):
                at = np.arange(b.counts[i]) if every else _places(own)
                np.add.at(near, b.first[i] + np.maximum(at - period + 1, 0), 1)
                np.add.at(near, b.first[i] + at + 1, -1)
            at = np.flatnonzero((np.cumsum(near)[:-1] > 0) & b.fits(length))
            yield from gather.add(texts, b.runs(at, length, WINDOW_BYTES), b.doc[at], b.at[at], k1, k2)
        yield from gather.flush()

    return dealt(candidates.mapInArrow(emit, ITEMS), ["bucket"], size).groupBy("bucket").applyInArrow(_repeats, "k1 long, k2 long, places binary")


def _keyed(docs: DataFrame, also: str | None = None) -> DataFrame:
    """Rows under a key made of the id and the text, so rows that repeat an id with another text stay apart."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.select(F.coalesce(doc_id, F.lit(0)).alias("k1"), F.xxhash64(doc_id, text).alias("k2"), text.alias("text"), doc_id.alias("doc_id"), *([also] if also else []))


def repeated_windows(docs: DataFrame, length: int = 35, also: str | None = None) -> DataFrame:
    """(doc_id, text, places array<binary>, whole boolean) of every row of ``docs``: starts, as 32-bit integers, of windows that occur
    elsewhere too; ``whole``: all of them do.

    Rows repeated whole have one key and one set of places. A key with more than one row in HOT_KEYS needs none, since its
    rows repeat all of each other's windows: they stay where they are, only other texts are dealt out by their keys.
    """
    keyed = _keyed(docs, also)
    sizes = keyed.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size"))
    more = F.col("n") > 1
    sizes = cut(sizes.groupBy(F.when(more, F.col("k1")).alias("k1"), F.when(more, F.col("k2")).alias("k2")).agg(F.sum("n").alias("n"), F.sum("size").alias("size")))
    size, n = (v or 0 for v in sizes.agg(F.sum("size"), F.sum("n")).first())
    hot = sizes.filter(F.col("k2").isNotNull() & (F.col("n") > 1) & (F.col("n") * HOT_KEYS > n)).select("k1", "k2")
    # About a word in six bytes, and a quarter of the words start an anchor; at most all of them a window.
    buckets, more = max(LEAST_GROUPS, -(-size // (24 * GROUP_ITEMS))), max(LEAST_GROUPS, -(-size // (12 * GROUP_ITEMS)))
    rows = keyed.select("k1", "k2", "text")
    anchors = _merge(_anchors(rows, length, buckets, size))  # items take about as many bytes as the texts
    own = ["k1", "k2", "text", "doc_id", *([also] if also else [])]
    hot_rows = keyed.join(F.broadcast(hot), ["k1", "k2"], "left_semi").select(*own, F.lit(None).cast("array<binary>").alias("places"), F.lit(True).alias("whole"))
    cold = dealt(keyed.join(F.broadcast(hot), ["k1", "k2"], "left_anti"), ["k1", "k2"], size)
    # The same columns as below, so that the texts are shuffled once and that exchange is used again.
    candidates = cold.join(anchors, ["k1", "k2"]).select(*own, "places", F.lit(False).alias("whole")).unionAll(hot_rows)
    windows = _merge(_windows(candidates, length, more, size))
    found = cold.join(windows, ["k1", "k2"], "left").select(*own, "places", F.lit(False).alias("whole")).unionAll(hot_rows)
    return found.select("doc_id", "text", "places", "whole", *([also] if also else []))


def _cleaned(text: bytes | None, values: list | None, whole: bool, length: int) -> tuple[int, int, bytes]:
    """Words, words removed, and the kept ones joined by a space."""
    words = (text or b"").split()
    n = len(words)
    if whole and n >= length:
        return n, n, b""
    if not values:
        return n, 0, b" ".join(words)
    at, cover = _places(values), np.zeros(n + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + length, -1)
    stays = np.flatnonzero(np.cumsum(cover)[:-1] == 0)
    return n, n - len(stays), b" ".join([words[i] for i in stays])


def rewrite(docs: DataFrame, length: int = 35) -> DataFrame:
    """``docs`` with repeated passages cut from the texts as in remove_repeats; all rows and columns stay.

    A document nothing is cut from keeps its text as it is, white space included; n_chars, where there is such a column,
    follows the new text.
    """
    # All but the text, which travels once, under a name of its own.
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("__own")
    found = repeated_windows(docs.select("doc_id", "text", rest), length, "__own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            done = [(t, _cleaned(t, v, whole, length)) for t, v, whole in zip(texts, *(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("places", "whole")), strict=True)]
            new = [kept if removed else t for t, (_, removed, kept) in done]
            own = batch.column(batch.schema.get_field_index("__own"))
            yield pa.RecordBatch.from_arrays([own, pa.array(new, pa.binary()).cast(pa.string()), pa.array([removed > 0 for _, (_, removed, _) in done])], ["__own", "__text", "__cut"])

    schema = T.StructType([T.StructField("__own", found.schema["__own"].dataType), T.StructField("__text", T.StringType()), T.StructField("__cut", T.BooleanType())])
    new = found.mapInArrow(run, schema)  # all columns, so that the exchange of the texts is the one used before
    size = F.when(F.col("__cut"), F.char_length("__text")).otherwise(F.col("__own.n_chars")).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return new.select(*(F.col("__text").alias(c) if c == "text" else size.alias(c) if c == "n_chars" else F.col(f"__own.`{c}`").alias(c) for c in docs.columns))


def remove_repeats(docs: DataFrame, length: int = 35) -> DataFrame:
    """(doc_id long, n_words long, n_removed long, kept_text string), one row per row of ``docs``.

    A window is ``length`` consecutive words (``[^\\x20\\x09-\\x0D]+``, unchanged) of one document. Every word covered by a
    window whose word sequence starts anywhere else too, in the same document or another, is removed; windows are judged on
    the input. Kept words are joined by one space. A null or wordless text has no words and an empty kept text. Rows repeated
    whole repeat each other's windows, so all their windowed words go.

    Windows that match share an anchor: whatever their starts, some offset below the period puts both on cover positions.
    Anchors that occur once are dropped; around the others whole windows are hashed and counted. Windows are equal where 96 bits
    of a hash made from their words' 128-bit hashes are. Equal hashes of one batch are settled there, so a passage in a third of all documents adds one item a batch to its group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            done = [_cleaned(t, v, whole, length) for t, v, whole in zip(texts, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            n_words, n_removed, kept = ([x[i] for x in done] for i in range(3))
            text = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), text], ["doc_id", "n_words", "n_removed", "kept_text"])

    return repeated_windows(docs, length).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string")
