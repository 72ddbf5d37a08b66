"""Language identification with hyperdimensional n-gram profiles."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayloom.llm.common import chunks, pick

FOLDS = 5
UNKNOWN = "und"
#: A letter is its code point, in two parts with a vector each that are bound together; 0 is anything but a letter.
LOW_BITS, POINT_BITS = 12, 21
SEED = 20240229
#: N-grams whose vectors are held at once.
BLOCK = 2048


def _letters() -> np.ndarray:
    """Each code point's lower-case letter, or 0."""
    letters = np.zeros(0x110000, np.uint32)
    points = [c for c in range(0x110000) if unicodedata.category(chr(c))[0] == "L"]
    letters[points] = points
    return letters


class _Space:
    """The letters' random +1/-1 vectors, permuted by their place in the n-gram; the same in every process."""

    _have: dict[tuple[int, int], _Space] = {}

    def __init__(self, dims: int, n: int):
        if not 1 <= n <= 64 // POINT_BITS:
            raise ValueError(f"n-grams have 1 to {64 // POINT_BITS} letters")
        rng = np.random.default_rng(SEED)
        low, high = (rng.integers(0, 2, (1 << bits, dims), np.int8) * 2 - 1 for bits in (LOW_BITS, POINT_BITS - LOW_BITS))
        high[0] = 1  # letters below 2**LOW_BITS need the one part only
        self.dims, self.n, self.letters = dims, n, _letters()
        self.placed = [tuple(np.roll(v, n - 1 - k, axis=1) for v in (low, high)) for k in range(n)]

    @classmethod
    def of(cls, dims: int, n: int) -> _Space:
        if (dims, n) not in cls._have:
            cls._have[dims, n] = cls(dims, n)
        return cls._have[dims, n]

    def grams(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each text has a letter; and the n-grams as (text, packed n-gram), runs of other characters as one space."""
        points = [np.frombuffer((t or b"").decode("utf-8", "replace").lower().encode("utf-32-le"), np.uint32) for t in texts]
        has, doc = np.zeros(len(texts), bool), np.repeat(np.arange(len(texts)), [len(p) + 2 for p in points])
        gap = np.zeros(1, np.uint32)
        line = np.concatenate([x for p in points for x in (gap, self.letters[p], gap)]) if points else gap[:0]
        keep = np.ones(len(line), bool)
        keep[1:] = (line[1:] != 0) | (line[:-1] != 0) | (doc[1:] != doc[:-1])
        line, doc = line[keep].astype(np.uint64), doc[keep]
        has[doc[line != 0]] = True
        m = max(0, len(line) - self.n + 1)
        packed, same = np.zeros(m, np.uint64), doc[:m] == doc[len(line) - m :]
        for k in range(self.n):
            packed = (packed << np.uint64(POINT_BITS)) + line[k : k + m]
        same &= packed != 0
        return has, doc[:m][same], packed[same]

    def vectors(self, packed: np.ndarray) -> np.ndarray:
        """The bound vectors of n-grams: the product of their letters' permuted vectors."""
        out = np.ones((len(packed), self.dims), np.int8)
        for k, (low, high) in enumerate(self.placed):
            point = (packed >> np.uint64(POINT_BITS * (self.n - 1 - k))).astype(np.int64) % (1 << POINT_BITS)
            out *= low[point % (1 << LOW_BITS)]
            if point.max(initial=0) >= 1 << LOW_BITS:
                out *= high[point >> LOW_BITS]
        return out.astype(np.float32)

    def bundles(self, texts: list[bytes | None], owner: np.ndarray | None = None, owners: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Whether each text has a letter; the sum of the n-gram vectors of each text (or of each owner's texts)."""
        has, doc, packed = self.grams(texts)
        owner, owners = (doc, len(texts)) if owner is None else (owner[doc], owners)
        seen, index = np.unique(packed, return_inverse=True)
        total = np.zeros((owners, self.dims), np.float32)
        for a in range(0, len(seen), BLOCK):  # bounds the vectors held at once
            own = (index >= a) & (index < a + BLOCK)
            part = np.bincount(owner[own] * BLOCK + index[own] - a, minlength=owners * BLOCK).astype(np.float32).reshape(owners, BLOCK)
            total += part[:, : len(seen) - a] @ self.vectors(seen[a : a + BLOCK])
        return has, total


def fold_of(doc_id: str = "doc_id"):
    """crc32 of the id as text modulo the folds; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS


class LanguageModel:
    """Prototypes (one unit vector a language) in the space of ``dims`` dimensions and ``n``-grams."""

    def __init__(self, langs: list[str], prototypes: np.ndarray, dims: int, n: int):
        self.langs, self.prototypes, self.dims, self.n = langs, prototypes, dims, n

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], np.ndarray]:
        """The language of each text and the cosine of its bundle with that prototype, 0 at least."""
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        has, sums = _Space.of(self.dims, self.n).bundles(texts)
        size = np.linalg.norm(sums, axis=1)
        cosine = (sums @ self.prototypes.T).astype(np.float64) / np.maximum(size, 1e-9)[:, None]
        best = cosine.argmax(axis=1)
        known = has & (size > 0)
        return [self.langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, np.clip(cosine.max(axis=1), 0, 1), 0)


def fit(docs: DataFrame, most_rows: int = 20_000, dims: int = 1024, n: int = 3, most_langs: int = 500) -> LanguageModel:
    """Prototypes learned from text and non-null lang of the rows outside the held-out fold.

    Fitted on a sample of about ``most_rows`` labelled rows, spread over the languages and chosen by a hash of the id; whole
    texts of the chosen rows are read. More than ``most_langs`` languages raise. Rows with a null doc_id are not learned from.
    """
    rows = pick(docs, doc_id="long", text="string", lang="string").filter((fold_of() != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().limit(most_langs + 1).collect()}
    if len(counts) > most_langs:
        raise ValueError(f"more than {most_langs} languages")
    langs = sorted(counts)
    if not langs:
        return LanguageModel([], np.zeros((0, dims), np.float32), dims, n)
    share, part = most_rows / len(langs), F.shiftright(F.xxhash64("doc_id"), 1) + F.lit(1 << 62)  # 0 to 2**63
    within = F.lit(False)
    for lang in langs:
        within |= (F.col("lang") == lang) & (part < F.lit(min((1 << 63) - 1, int(share / counts[lang] * (1 << 63)))))
    place = {lang: i for i, lang in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, total = _Space.of(dims, n), np.zeros((len(langs), dims), np.float64)
        for batch, texts in chunks(batches):
            owner = np.fromiter((place[x] for x in batch.column(1).to_pylist()), np.int64, len(texts))
            total += space.bundles(texts, owner, len(langs))[1]
        yield pa.RecordBatch.from_arrays([pa.array(langs), pa.array([t.tobytes() for t in total], pa.binary())], ["lang", "total"])

    sums = {lang: np.zeros(dims) for lang in langs}
    # All tasks filter; only the sample is dealt out anew, so 64 sums a language come to the driver whatever the input.
    for lang, total in rows.filter(within).repartition(64, "doc_id").select("text", "lang").mapInArrow(run, "lang string, total binary").collect():
        sums[lang] += np.frombuffer(bytes(total), np.float64)  # whole numbers, so their order does not matter
    seen = [lang for lang in langs if np.linalg.norm(sums[lang])]
    unit = np.array([sums[lang] / np.linalg.norm(sums[lang]) for lang in seen], np.float32).reshape(len(seen), dims)
    return LanguageModel(seen, unit, dims, n)


def predict(docs: DataFrame, model: LanguageModel, also: dict[str, str] | None = None) -> DataFrame:
    """(doc_id long, lang_pred string, score double) of every whole text; only the text is looked at.

    lang_pred is ``und`` with score 0 for a null text and one without a letter; score is the cosine with the prototype
    chosen. ``also`` names further columns to carry along. One row per row of ``docs``; an empty table gives no rows.
    """
    also = also or {}
    sent = docs.sparkSession.sparkContext.broadcast(model)  # dims x languages, both bounded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, most=1 << 19):
            lang, score = sent.value.predict(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(batch.column(i) for i in range(2, 2 + len(also))), pa.array(lang), pa.array(score)], ["doc_id", *also, "lang_pred", "score"])

    extra = "".join(f"`{c}` {kind}, " for c, kind in also.items())
    return pick(docs, doc_id="long", text="string", **also).mapInArrow(run, f"doc_id long, {extra}lang_pred string, score double")


def identify(docs: DataFrame, **how) -> DataFrame:
    """Fit on ``docs`` outside the held-out fold, predict all of it: (doc_id, held_out boolean, lang_pred, score).

    held_out is true where crc32 of the id as text is divisible by 5; null where doc_id is null.
    """
    return predict(docs, fit(docs, **how)).select("doc_id", (fold_of() == 0).alias("held_out"), "lang_pred", "score")


#: Texts whose cosine with the nearest language is under this are in none of them.
LEAST_SCORE = 0.05


def keep_identified(docs: DataFrame, model: LanguageModel | None = None, least: float = LEAST_SCORE) -> DataFrame:
    """``docs`` without the documents that language ID rejects: ``und``, or a score under ``least``. All columns and repeated rows stay;
    a null lang becomes the language found.

    The whole row passes through the prediction, so nothing is joined back and no id needs to be unique. Where no language could
    be learned (no row has a lang), only texts without a letter are rejected. An empty table gives no rows.
    """
    fitted = fit(docs) if model is None else model
    sent, place = docs.sparkSession.sparkContext.broadcast(fitted), docs.columns.index("text")
    named = docs.columns.index("lang") if "lang" in docs.columns else None
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # whatever the names are

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch, texts in chunks(batches, f"c{place}", 1 << 19):
            if not model.langs:
                yield batch.filter(pa.array(_Space.of(model.dims, model.n).grams(texts)[0]))
                continue
            lang, score = model.predict(texts)
            if named is not None:
                batch = batch.set_column(named, batch.schema.field(named), pc.coalesce(batch.column(named), pa.array(lang, batch.schema.field(named).type)))
            yield batch.filter(pa.array([x != UNKNOWN and y >= least for x, y in zip(lang, score, strict=True)]))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
