"""Benchmark passages in training documents, found by suffix arrays over shards of the documents."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayloom.llm.common import chunks, cut, pick, tidy

#: Bytes of text, and words, that one suffix array is over; a longer document goes on in the next one.
SHARD_BYTES, SHARD_WORDS = 8 << 20, 2 << 20
#: Bytes of items that are searched for in one pass over the documents.
BLOCK_BYTES = 16 << 20
#: Words of a piece of an item; longer items are searched for in pieces that overlap by all but one word of a window.
PIECE_WORDS = 1 << 16
#: Bytes that words are cut from at once.
STEP = 4 << 20

#: A-Z in lower case; every other byte that is neither a digit nor a letter nor beyond ASCII ends a word.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))

SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
FOUND = [T.StructField("n_words", T.LongType()), T.StructField("spans", SPAN), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("longest", T.LongType()), T.StructField("longest_start", T.LongType()), T.StructField("longest_item", T.StringType())]
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def _words(text: bytes | None) -> Iterator[list[bytes]]:
    """The words of a text, a few megabytes at a time."""
    text, a = (text or b"").translate(_NORMAL), 0
    while a < len(text):
        b = text.find(b" ", a + STEP)
        b = len(text) if b < 0 else b
        yield text[a:b].split()
        a = b


class Items:
    """Items as numbers of words: ``words`` with a 0 after each, and of every suffix that can start a window its place, the window's
    length, and its item's number. Items of equal words are one."""

    def __init__(self, lines: list[bytes], ids: list[str | None], window: int):
        known: dict[bytes, int] = {}
        named: list[list[str]] = []
        self.vocabulary: dict[bytes, int] = {}
        words, at, need, item = [], [], [], []
        for line, name in zip(lines, ids, strict=True):
            if (k := known.setdefault(line, len(known))) == len(named):
                named.append([])
                own = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in line.split()]
                starts = range(len(words), len(words) + max(1, len(own) - window + 1))
                at += starts
                need += [min(window, len(own))] * len(starts)
                item += [k] * len(starts)
                words += [*own, 0]
            if name is not None:
                named[k].append(name)
        self.names = [np.array(sorted(set(n)), object) for n in named]
        self.longest = max((len(line.split()) for line in known), default=0)
        self.words = np.array(words, np.int64)
        self.at, self.need, self.item = (np.array(v, np.int64) for v in (at, need, item))


def suffix_array(words: np.ndarray, size: int, depth: int) -> np.ndarray:
    """Places of known words (above 0, at most ``size``), in the order of the words from there on, as far as ``depth`` of them. Packed runs
    of words are sorted first; ties are then parted by the ranks of what follows, at twice the distance each time."""
    n, bits = len(words), max(1, int(size).bit_length())
    run = max(1, min(62 // bits, 8))
    padded = np.concatenate((words, np.zeros(run, np.int64)))
    key = np.zeros(n, np.int64)
    for k in range(run):
        key = (key << bits) | padded[k : k + n]
    order = np.flatnonzero(words > 0)
    order = order[np.argsort(key[order], kind="stable")]
    rank = np.full(n + 1, -1, np.int64)  # a rank is where its group starts in the order

    def groups(keys: np.ndarray, base: np.ndarray) -> np.ndarray:
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (base[1:] != base[:-1])
        return new

    new = groups(key[order], np.zeros(len(order), np.int64))
    start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    rank[order] = start
    done = run
    while done < depth and len(order):
        counts = np.bincount(start, minlength=len(order))
        tied = np.flatnonzero(counts[start] > 1)  # places in the order
        if not len(tied):
            break
        mine, next_rank = order[tied], rank[np.minimum(order[tied] + done, n)]
        by = np.lexsort((next_rank, start[tied]))
        mine, next_rank, base = mine[by], next_rank[by], start[tied]  # lexsort keeps the groups where they are
        order[tied] = mine
        new = groups(next_rank, base)
        start[tied] = np.maximum.accumulate(np.where(new, tied, 0))
        rank[order] = start
        done *= 2
    return order


def _bound(words: np.ndarray, order: np.ndarray, lo: np.ndarray, hi: np.ndarray, want: np.ndarray, depth: int, right: bool) -> np.ndarray:
    """The first place within [lo, hi) of the order whose word ``depth`` places on is not under (``right``: is over) the wanted one."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        there = words[np.where(open_, order[np.where(open_, mid, 0)] + depth, 0)]
        go = open_ & ((there <= want) if right else (there < want))
        lo, hi = np.where(go, mid + 1, lo), np.where(open_ & ~go, mid, hi)
    return lo


def _expand(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The members of all ranges, and each one's range."""
    sizes = hi - lo
    which = np.repeat(np.arange(len(lo)), sizes)
    return np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + lo[which], which


class Matches:
    """What a shard holds of the items: ``windows`` (lo, hi, length) of the order with the suffixes that start there, and of every
    place of the shard the length of its longest match with an item, if a window's at least, and that item."""

    def __init__(self, words: np.ndarray, items: Items):
        self.order = suffix_array(words, len(items.vocabulary), items.longest)
        self.best, self.item = np.zeros(len(words), np.int32), np.zeros(len(words), np.int32)
        self.windows: list[tuple[np.ndarray, ...]] = []
        words = np.concatenate((words, [0]))
        first = words[self.order]
        own = items.words[items.at]
        lo, hi = np.searchsorted(first, own, "left"), np.searchsorted(first, own, "right")
        j, depth = np.flatnonzero(lo < hi), 1
        lo, hi = lo[j], hi[j]
        while len(j):
            full = items.need[j] == depth
            self.windows.append((lo[full], hi[full], np.full(full.sum(), depth), items.item[j[full]]))
            want = items.words[items.at[j] + depth]
            a = _bound(words, self.order, lo, hi, want, depth, False)
            b = _bound(words, self.order, a, hi, want, depth, True)
            a, b = np.where(want > 0, a, hi), np.where(want > 0, b, hi)  # the item has ended: nothing goes on
            enough = items.need[j] <= depth
            self._note(np.concatenate((lo[enough], b[enough])), np.concatenate((a[enough], hi[enough])), np.tile(items.item[j[enough]], 2), depth)
            stay = a < b
            j, lo, hi, depth = j[stay], a[stay], b[stay], depth + 1

    def _note(self, lo: np.ndarray, hi: np.ndarray, item: np.ndarray, depth: int) -> None:
        """The suffixes of these ranges match their item for ``depth`` words and no more."""
        ranges, one = np.unique(np.stack((lo, hi), axis=1)[lo < hi], axis=0, return_index=True)
        item = item[lo < hi][one]
        at, which = _expand(ranges[:, 0], ranges[:, 1])
        self.best[self.order[at]], self.item[self.order[at]] = depth, item[which]


def _of_shard(words: np.ndarray, part: np.ndarray, items: Items) -> Iterator[tuple[int, np.ndarray, list[str], int, int, str | None]]:
    """(part, covered places, item names, longest match, its place, its item) of each part of a shard that holds a window."""
    found = Matches(words, items)
    lo, hi, need, item = (np.concatenate(v) for v in zip(*found.windows, strict=True)) if found.windows else (np.zeros(0, np.int64),) * 4
    if not len(lo):
        return
    ranges, which = np.unique(np.stack((lo, hi, need), axis=1), axis=0, return_inverse=True)
    pairs = np.unique(np.stack((which.ravel(), item), axis=1), axis=0)
    first = np.searchsorted(pairs[:, 0], np.arange(len(ranges) + 1))
    at, of = _expand(ranges[:, 0], ranges[:, 1])
    at, length = found.order[at], ranges[of, 2]
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + length, -1)
    covered = np.cumsum(cover)[:-1] > 0
    held = np.unique(np.stack((part[at], of), axis=1), axis=0)
    bounds = np.searchsorted(part, np.arange(part[-1] + 2))
    for p, own in zip(*_grouped(held), strict=True):
        a, b = bounds[p], bounds[p + 1]
        classes = np.unique(np.concatenate([pairs[first[k] : first[k + 1], 1] for k in own]))
        names = sorted(set().union(*(items.names[c] for c in classes)))
        top = a + int(found.best[a:b].argmax())
        name = items.names[found.item[top]]
        yield p, np.flatnonzero(covered[a:b]), names, int(found.best[top]), top - a, name[0] if len(name) else None


def _grouped(pairs: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    cuts = np.flatnonzero(np.diff(pairs[:, 0])) + 1
    return [int(v) for v in pairs[np.concatenate(([0], cuts)), 0]], np.split(pairs[:, 1], cuts)


class _Row:
    """One document's result so far."""

    def __init__(self, own: tuple):
        _, self.spans, items, self.longest, self.start, self.item = own
        self.spans = [(s["start"], s["stop"]) for s in self.spans or []]
        self.items, self.n = set(items or []), 0

    def add(self, places: np.ndarray, names: list[str], longest: int, start: int, item: str | None, offset: int) -> None:
        cuts = np.flatnonzero(np.diff(places) > 1)
        starts, stops = places[np.concatenate(([0], cuts + 1))] + offset, places[np.concatenate((cuts, [len(places) - 1]))] + 1 + offset
        self.spans += zip(starts.tolist(), stops.tolist(), strict=True)
        self.items.update(names)
        if longest > (self.longest or 0):
            self.longest, self.start, self.item = longest, start + offset, item

    def done(self) -> tuple:
        merged: list[list[int]] = []
        for a, b in sorted(self.spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        return self.n, [{"start": a, "stop": b} for a, b in merged], sorted(self.items), self.longest or 0, self.start, self.item


def _searched(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[pa.RecordBatch]:
    """The batches with their results, a shard of texts at a time."""
    kinds = [pa.int64(), _SPANS, pa.list_(pa.string()), pa.int64(), pa.int64(), pa.string()]
    look = items.vocabulary.get
    for batch, texts in chunks(batches, most=SHARD_BYTES):
        states = [batch.column(f.name).to_pylist() for f in FOUND]
        rows = [_Row(own) for own in zip(*states, strict=True)]
        parts: list[tuple[int, int]] = []  # (row, offset of its first word)
        words: list[np.ndarray] = []
        size = 0

        def search(words: list[np.ndarray], parts: list[tuple[int, int]], rows: list[_Row] = rows) -> None:
            if parts:
                ids = np.concatenate([w for own in words for w in (own, [0])]).astype(np.int64)
                part = np.repeat(np.arange(len(parts)), [len(own) + 1 for own in words])
                for p, *found in _of_shard(ids, part, items):
                    rows[parts[p][0]].add(*found, parts[p][1])

        for k, text in enumerate(texts):
            kept, offset = np.zeros(0, np.int32), 0
            for own in _words(text):
                rows[k].n += len(own)
                kept = np.concatenate((kept, np.fromiter(map(look, own, repeat(0)), np.int32, len(own))))
                while len(kept) > SHARD_WORDS + items.longest:  # the next part starts where a match may have been cut
                    search([kept[: SHARD_WORDS + items.longest]], [(k, offset)])
                    kept, offset = kept[SHARD_WORDS:], offset + SHARD_WORDS
            if kept.any():
                words.append(kept)
                parts.append((k, offset))
                size += len(kept)
            if size > SHARD_WORDS:
                search(words, parts)
                words, parts, size = [], [], 0
        search(words, parts)
        done = zip(*(r.done() for r in rows), strict=True)
        own = [c for c, f in zip(batch.columns, batch.schema, strict=True) if f.name not in {x.name for x in FOUND}]
        names = [f.name for f in batch.schema if f.name not in {x.name for x in FOUND}]
        yield pa.RecordBatch.from_arrays([*own, *(pa.array(list(v), t) for v, t in zip(done, kinds, strict=True))], [*names, *(f.name for f in FOUND)])
    tidy()


def _pieces(benchmark: DataFrame, window: int) -> DataFrame:
    """(item_id string, line string): the words of each item joined by a space; items of very many words in pieces that share windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            out = []
            for name, text in zip(batch.column("item_id").to_pylist(), texts, strict=True):
                words = [w for own in _words(text) for w in own]
                step = PIECE_WORDS - window + 1
                out += [(name, b" ".join(words[a : a + PIECE_WORDS]).decode()) for a in range(0, max(1, len(words) - window + 1), step) if words]
            yield pa.RecordBatch.from_arrays([pa.array([v[k] for v in out], pa.string()) for k in (0, 1)], ["item_id", "line"])

    return pick(benchmark, item_id="string", text="string").mapInArrow(run, "item_id string, line string").distinct()


def _scan(docs: DataFrame, benchmark: DataFrame, window: int, clean: bool) -> DataFrame:
    """The columns of ``docs``, one of them text, and those of FOUND; ``clean`` lets only rows without any window on."""
    if window < 1:
        raise ValueError("a window has at least one word")
    pieces = cut(_pieces(benchmark, window))
    size = pieces.agg(F.sum(F.octet_length("line"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    schema = T.StructType([*docs.schema.fields, *FOUND])
    found = docs.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in FOUND))
    for k in range(max(1, blocks)):
        own = pieces.filter(F.pmod(F.xxhash64("item_id", "line"), F.lit(max(1, blocks))) == k).collect()  # BLOCK_BYTES, give or take a piece
        lines, ids = [r.line.encode() for r in own], [r.item_id for r in own]

        def run(batches: Iterator[pa.RecordBatch], lines: list[bytes] = lines, ids: list[str | None] = ids) -> Iterator[pa.RecordBatch]:
            yield from _searched(batches, Items(lines, ids, window))

        found = found.mapInArrow(run, schema)
        found = found.filter(F.size("spans") == 0) if clean else found
    return found


def find(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """(doc_id long, n_words long, spans array of (start, stop), items array<string>, longest long, longest_start long, longest_item
    string), one row per row of ``docs``.

    A-Z are lower-cased; words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of whole texts. A window is ``window`` consecutive words of an
    item; an item of fewer words, but not none, is one window. ``spans`` are the word ranges that occurrences of windows
    cover, ``items`` the ids (as text, sorted) of items with windows that occur, ``longest`` the words of the longest verbatim match
    that holds a window, with its place and one item it is from (0 and null without any).

    Documents are taken in shards; a shard's suffixes are sorted by their words and every suffix of an item that can start a window is
    found by binary search, word by word. Null texts have no words. An item without an id hits, but has no name to list; ids
    repeated with other texts are one name. Longer benchmarks than BLOCK_BYTES are searched for in blocks, a pass over the
    documents each; an item is in pieces of PIECE_WORDS, which bounds the longest match. No documents, no rows; no items, no hits.
    """
    return _scan(pick(docs, doc_id="long", text="string"), benchmark, window, False).drop("text")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` without the rows that hold a window of any item; all columns stay as they are."""
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("__own") if len(docs.columns) > 1 else F.lit(None).cast("string").alias("__own")
    found = _scan(docs.select(F.col("text").cast("string").alias("text"), rest), benchmark, window, True)
    return found.select(*(F.col("text") if c == "text" else F.col(f"__own.`{c}`").alias(c) for c in docs.columns))
