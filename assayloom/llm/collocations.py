"""Phrases whose words occur together more often than their parts suggest, per language."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayloom.llm.common import LOWER, chunks, cut, mix, spread_join, tidy

#: Text bytes whose phrases are counted together before they become rows.
TOGETHER = 8 << 20
#: Bits of the filter that says which shorter phrases may be frequent, a power of two. Its size is the same for any input; where it fills
#: up, more phrases are counted, and the counts say what is frequent.
FILTER_BITS = 1 << 26
#: Bits of a pair's hash, beyond those of its place in the filter, by which pairs are told apart when they are counted for it.
MORE_BITS = 9
#: Hashes of pairs that are kept before they are added up, and groups that they are dealt out to at most.
MOST_PAIRS, MOST_BUCKETS = 1 << 22, 1 << 12

#: Bytes that end a piece, A-Z in lower case, and tabs as spaces.
_NORMAL = bytearray(LOWER)
for _c in b".,;:!?\n\x0b\x0c\r":
    _NORMAL[_c] = 10
_NORMAL[9] = 32
_NORMAL = bytes(_NORMAL)
_END = re.compile(rb"[.,;:!?\x0A-\x0D]")

ROWS = "lang string, phrase string, c long"


class _Phrases:
    """The words of a slice of texts of one language, as numbers of distinct words."""

    def __init__(self, lang: str, texts: list[bytes]):
        self.lang = lang
        data = np.frombuffer(b"\n".join(texts).translate(_NORMAL) + b"\n", np.uint8)
        inside = (data != 32) & (data != 10)
        edge = np.flatnonzero(np.diff(inside, prepend=False))  # starts and ends in turn; the last byte is no word's
        starts, ends = edge[::2], edge[1::2]
        offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[inside]))])
        coded = words.dictionary_encode()
        self.code, self.distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        piece = np.concatenate(([0], np.cumsum(data == 10)))[starts]
        self.last = np.searchsorted(piece, piece, "right") - np.arange(len(piece))  # words from here to the end of the piece
        seed = xxhash.xxh64_intdigest(lang.encode())
        self.hash = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.distinct.cast(pa.large_binary()).to_pylist()), np.uint64, len(self.distinct))

    def counted(self, size: int, at: np.ndarray) -> pa.RecordBatch:
        """How often each phrase of ``size`` words that starts at one of the places occurs."""
        key, held = self.code[at], [self.code[at]]
        for k in range(1, size):
            held.append(self.code[at + k])
            key = np.unique(key * len(self.distinct) + held[-1], return_inverse=True)[1] if k < size - 1 else key * len(self.distinct) + held[-1]
        _, first, counts = np.unique(key, return_index=True, return_counts=True)
        parts = [self.distinct.take(pa.array(h[first])) for h in held]
        phrase = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if size > 1 else parts[0]
        return pa.RecordBatch.from_arrays([pa.array([self.lang] * len(first), pa.string()), phrase.cast(pa.string()), pa.array(counts, pa.int64())], ["lang", "phrase", "c"])

    def hashes(self, size: int) -> np.ndarray:
        """Hashes of the phrases of ``size`` words that start at each place; where the piece ends before, of no meaning."""
        out = self.hash[self.code]
        for k in range(1, size):
            out[: len(out) - k] = _follow(out[: len(out) - k], self.hash[self.code[k:]])
        return out

    def maybe(self, size: int, bits: np.ndarray | None, known: int) -> np.ndarray:
        """Places where a phrase of ``size`` words starts all of whose parts of ``known`` words may be frequent."""
        ok = self.last >= size
        if bits is not None and len(ok) >= size:
            at = self.hashes(known) >> np.uint64(65 - (len(bits) << 3).bit_length())
            hit = (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
            for k in range(size - known + 1):
                ok[: len(ok) - k] &= hit[k:]
        return np.flatnonzero(ok)


def _follow(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0x9FB21C651E98DF25) + (b ^ (b >> np.uint64(31))))


def _parts(text: bytes, most: int) -> Iterator[bytes]:
    """A text; a very long one from one end of a piece to another, since no phrase crosses it."""
    a = 0
    while a < len(text):
        end = _END.search(text, a + most)
        b = end.end() if end else len(text)
        yield text[a:b]
        a = b


def _langs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[_Phrases]:
    """Phrases of slices of the batches, a language at a time."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch, texts in chunks(batches, most=most):
        for lang, text in zip(batch.column("lang").to_pylist(), texts, strict=True):
            for part in _parts(text or b"", most):
                held.setdefault(lang, []).append(part)
                size += len(part)
                if size >= most:
                    yield from (_Phrases(k, v) for k, v in held.items())
                    held, size = {}, 0
    yield from (_Phrases(k, v) for k, v in held.items())


def _exploded(docs: DataFrame, sizes: range, bits: np.ndarray | None, known: int) -> DataFrame:
    """(lang, phrase, c): phrases of these sizes as rows, counted within a few megabytes of text; a null phrase has the number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for phrases in _langs(batches, TOGETHER):
            if sizes[0] == 1:
                yield pa.RecordBatch.from_arrays([pa.array([phrases.lang], pa.string()), pa.array([None], pa.string()), pa.array([len(phrases.code)], pa.int64())], ["lang", "phrase", "c"])
            for size in sizes:
                at = phrases.maybe(size, bits, known)
                if len(at):
                    yield phrases.counted(size, at)
        tidy()

    return docs.mapInArrow(run, ROWS)


def _filter(frequent: DataFrame) -> np.ndarray:
    """FILTER_BITS bits, set where a word of ``frequent`` (lang, phrase) hashes to."""
    slice_bytes = 1 << 15

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS >> 3, np.uint8)
        for batch in batches:
            for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist(), strict=True):
                at = xxhash.xxh64_intdigest(phrase.encode(), xxhash.xxh64_intdigest(lang.encode())) >> 65 - FILTER_BITS.bit_length()
                bits[at >> 3] |= 1 << (at & 7)
        rows = bits.reshape(-1, slice_bytes)
        used = np.flatnonzero(rows.any(axis=1))
        for a in range(0, len(used), 64):
            own = used[a : a + 64]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([rows[k].tobytes() for k in own], pa.binary())], ["slice", "bits"])

    def union(slice_: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(slice_bytes, np.uint8)
        for batch in parts:
            for own in batch.column("bits").to_pylist():
                bits |= np.frombuffer(own, np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([slice_[0].as_py()], pa.int64()), pa.array([bits.tobytes()], pa.binary())], ["slice", "bits"])

    out = np.zeros(FILTER_BITS >> 3, np.uint8).reshape(-1, slice_bytes)
    found = frequent.select("lang", "phrase").mapInArrow(run, "slice long, bits binary").groupBy("slice").applyInArrow(union, "slice long, bits binary")
    for r in found.toLocalIterator():  # at most FILTER_BITS
        out[r.slice] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of each one's counts."""
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k)
    k, c = k[order], c[order]
    first = np.flatnonzero(np.diff(k, prepend=-1))
    return k[first], np.add.reduceat(c, first) if len(first) else c


def _gaps(keys: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending keys as 16-bit steps from one to the next, a long step as several, and where the steps of each key end; at the
    places ``first`` they begin anew, from -1."""
    step = np.diff(keys, prepend=-1)
    step[first] = keys[first] + 1
    long, rest = np.divmod(step - 1, 65535)
    ends = np.cumsum(long + 1)
    out = np.full(ends[-1] if len(ends) else 0, 65535, np.uint16)
    out[ends - 1] = rest
    return out, ends


def _from_gaps(raw: bytes) -> np.ndarray:
    steps = np.frombuffer(raw, np.uint16).astype(np.int64)
    return (np.cumsum(steps + (steps < 65535)) - 1)[steps < 65535]


def _pair_filter(rows: DataFrame, bits: np.ndarray, least: int, words: int) -> np.ndarray:
    """FILTER_BITS bits, set where a pair of words of ``rows`` hashes to that may occur ``least`` times; ``bits`` is the filter of words.

    Pairs are counted by a few more bits of their hash than the filter has places, so their strings need not travel: each task adds up its
    own and packs them by ranges of hashes, about two bytes a pair; each range is then a stretch of the filter.
    """
    places = FILTER_BITS.bit_length() - 1
    buckets = 64
    while buckets < min(MOST_BUCKETS, FILTER_BITS >> 3, words >> 20):
        buckets *= 2
    per = (1 << places + MORE_BITS) // buckets
    kind = np.uint8 if least < 256 else np.int64

    def packed(keys: list[np.ndarray], counts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not sum(map(len, keys)):
            return
        k, c = _added(keys, counts)
        c = np.minimum(c, least).astype(kind)  # as good as any higher count
        bucket = k // per
        first = np.flatnonzero(np.diff(bucket, prepend=-1))
        steps, ends = _gaps(k % per, first)
        stops = np.append(first[1:], len(k))
        cuts = np.concatenate(([0], ends[stops - 1]))
        data = [steps[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], [c[a:b].tobytes() for a, b in zip(first, stops, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[first], pa.int64()), *(pa.array(v, pa.binary()) for v in data)], ["bucket", "steps", "counts"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, n = [], [], 0
        for phrases in _langs(batches, TOGETHER):
            own = phrases.hashes(2)[phrases.maybe(2, bits, 1)] >> np.uint64(64 - places - MORE_BITS)
            k, c = np.unique(own.astype(np.int64), return_counts=True)
            keys.append(k)
            counts.append(c)
            n += len(k)
            if n > MOST_PAIRS:
                yield from packed(keys, counts)
                keys, counts, n = [], [], 0
        yield from packed(keys, counts)
        tidy()

    def union(bucket: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, n = [], [], 0
        for batch in parts:
            for steps, own in zip(batch.column("steps").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                keys.append(_from_gaps(steps))
                counts.append(np.frombuffer(own, kind).astype(np.int64))
                n += len(counts[-1])
                if n > MOST_PAIRS:
                    keys, counts = ([v] for v in _added(keys, counts))
                    n = len(keys[0])
        k, c = _added(keys, counts)
        flags = np.zeros(FILTER_BITS // buckets, bool)
        flags[k[c >= least] >> MORE_BITS] = True
        yield pa.RecordBatch.from_arrays([pa.array([bucket[0].as_py()], pa.int64()), pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())], ["bucket", "bits"])

    out = np.zeros(FILTER_BITS >> 3, np.uint8).reshape(buckets, -1)
    for r in rows.mapInArrow(emit, "bucket long, steps binary, counts binary").groupBy("bucket").applyInArrow(union, "bucket long, bits binary").toLocalIterator():  # at most FILTER_BITS
        out[r.bucket] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


def counts(docs: DataFrame, max_n: int = 5, least: int = 100) -> tuple[DataFrame, DataFrame]:
    """(lang, n) with every language's words, and (lang, phrase, a) with all phrases of 1 to ``max_n`` words that occur ``least`` times.

    Phrases become rows and are added up per language. A phrase occurs at most as often as any part of it, so those with a part that is too rare are
    left out before they become rows: words first, then pairs of frequent words by their hashes, then all phrases of two and more words whose
    pairs may be frequent. ``may be`` is a filter of a fixed size, which is never wrong the other way; what is frequent, the counts
    of the phrases themselves say.
    """
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))

    def summed(sizes: range, bits: np.ndarray | None, known: int) -> DataFrame:
        return cut(_exploded(rows, sizes, bits, known).groupBy("lang", "phrase").agg(F.sum("c").alias("a")).filter((F.col("a") >= least) | F.col("phrase").isNull()))

    words = summed(range(1, 2), None, 1)
    total, found = words.filter("phrase is null").select("lang", F.col("a").alias("n")), words.filter("phrase is not null")
    if max_n > 1:
        n = total.agg(F.sum("n")).first()[0] or 0
        found = found.unionAll(summed(range(2, max_n + 1), _pair_filter(rows, _filter(found), least, n), 2))
    return total, found


def mine(docs: DataFrame, max_n: int = 5, least: int = 100, share: int = 100, top: int = 2000) -> DataFrame:
    """(lang, rank long, phrase, a long, l long, r long, n long, score long): the first ``top`` phrases of each language.

    A-Z are lower-cased; texts are split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those into words ``[^\\x20\\x09]+``. n counts a language's
    words, a phrase's occurrences within pieces are a, overlaps included. Candidates have 2 to ``max_n`` words and occur ``least`` times.
    Cut after its first k words, a candidate has l and r, how often its two parts occur, and the score floor(1000 a n / (l r)); its
    lowest score counts, ties to the smaller k. A candidate inside a longer one that occurs in at least ``share`` percent of its
    places is dropped. Ranks go by score, then a, both descending, then the phrase's UTF-8. Null texts are empty, a null lang is ``und``
    (and counts with rows that say so). Products are decimals of 38 digits. No documents, or none with frequent phrases, no rows.
    """
    total, found = counts(docs, max_n, least)
    words = F.split("phrase", " ")
    sized = found.select("lang", "phrase", "a", F.size(words).alias("size"))
    parts = found.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    k = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    join = lambda a, b: F.array_join(F.slice(words, a, b), " ")
    cuts = sized.filter("size > 1").select("lang", "phrase", "a", "size", k).select("*", join(F.lit(1), F.col("k")).alias("left"), join(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    cuts = cuts.join(parts.select("lang", F.col("part").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(parts.select("lang", F.col("part").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    d = lambda c: F.col(c).cast("decimal(19,0)")
    scored = spread_join(cuts, total.withColumn("copies", F.col("n")), "lang").withColumn("up", F.lit(1000).cast("decimal(4,0)") * d("a") * d("n")).withColumn("down", d("l") * d("r"))
    best = scored.select("lang", "phrase", "a", "n", F.struct(F.expr("up div down").alias("score"), "k", "l", "r").alias("cut")).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), F.min("cut").alias("cut"))
    # A longer candidate holds one with a word less on either side; whichever of those has the phrase in it occurs no less often than the longest.
    longer = sized.filter("size > 2").select("lang", F.explode(F.array(join(F.lit(1), F.col("size") - 1), join(F.lit(2), F.col("size") - 1))).alias("phrase"), F.col("a").alias("more"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("more").alias("more")).select(F.col("lang").alias("in_lang"), F.col("phrase").alias("inner"), "more")
    left = best.join(longer, (F.col("lang") == F.col("in_lang")) & (F.col("phrase") == F.col("inner")) & (F.lit(100) * F.col("more") >= F.lit(share) * F.col("a")), "left_anti")
    order = [F.desc("cut.score"), F.desc("a"), F.asc("phrase")]
    # The best of each of many parts of a language first, so that no task sorts all its phrases.
    some = left.withColumn("seat", F.pmod(F.xxhash64("phrase"), F.lit(256))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "seat").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
