"""SimHash near-duplicates found by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayloom.llm.common import LOWER, chunks, cut, spread_join
from assayloom.llm.components import connected_components

BITS = 64
#: Hashes unpacked to bits at once.
STEP = 1 << 16


def _sketch(texts: list[bytes | None], words: int, seed: int) -> np.ndarray:
    """The fingerprints of whole texts as unsigned 64-bit integers."""
    digest, hashes, sizes = xxhash.xxh64_digest, [], []
    for text in texts:
        tokens = (text or b"").translate(LOWER).split()
        n = len(tokens)
        if not n:
            sizes.append(0)
            continue
        line = b" ".join(tokens)
        if n <= words:
            hashes.append(digest(line, seed))
            sizes.append(1)
            continue
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, n)) + np.arange(n)
        starts = np.concatenate(([0], ends[: n - words] + 1)).tolist()
        hashes += [digest(line[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)]
        sizes.append(n - words + 1)
    out, a = np.zeros(len(texts), np.uint64), 0
    rows = np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, 8)
    for k, n in enumerate(sizes):
        if n:
            totals = sum(np.unpackbits(rows[b : min(b + STEP, a + n)], axis=1).sum(0, dtype=np.int64) for b in range(a, a + n, STEP))
            out[k] = int.from_bytes(np.packbits(2 * totals > n).tobytes())
            a += n
    return out


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, keyed: bool = False) -> DataFrame:
    """(doc_id long, fp long): the SimHash of each whole text, one row per row of ``docs``; fp holds the 64 bits, signed.

    A-Z are lower-cased, words are ``[^\\x20\\x09-\\x0D]+``, shingles of ``words`` words with repeats are joined by one space
    and hashed by XXH64 of their UTF-8. A bit is set if more than half of the hashes have it. A text of fewer words has one
    shingle; null and wordless texts get 0. ``keyed`` adds key long, a hash of id and text.
    """
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(_sketch(texts, words, seed).view(np.int64))], [*names, "fp"])

    names = ["doc_id", "key"] if keyed else ["doc_id"]
    sent = docs.select(doc_id.alias("doc_id"), F.xxhash64(doc_id, text).alias("key"), text.alias("text")).select(*names, "text")
    return sent.mapInArrow(run, "".join(f"{c} long, " for c in names) + "fp long")


def _masks(radius: int) -> list[int]:
    masks = [sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(BITS), k)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def link_near(prints: DataFrame, radius: int = 2) -> DataFrame:
    """(src, dst) links between the fingerprints of ``prints`` (node long, fp long, distinct fp) that differ in at most ``radius`` bits.

    Every fingerprint emits all variants within ``radius / 2`` bits; two that are within the radius meet at some variant, and
    all that meet at a variant are within the radius of each other. So each meeting place links its members to one of them,
    which keeps every connection without all pairs; a place has as many members as a ball has variants at most (65 at radius
    2). Links are deduplicated and their distance is verified.
    """
    if radius % 2 or not 0 <= radius <= 4:
        raise ValueError("the radius is 0, 2 or 4: halves must meet in the middle")
    balls = prints.select("node", "fp", F.explode(F.array(*(F.lit(m).cast("long") for m in _masks(radius // 2)))).alias("mask"))
    place = Window.partitionBy("variant")
    met = balls.select("node", "fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant")).withColumn("head", F.min(F.struct("node", "fp")).over(place))
    return met.filter("node <> head.node").select(F.col("node").alias("src"), F.col("head.node").alias("dst"), "fp", F.col("head.fp").alias("head_fp")).distinct().filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("head_fp"))) <= radius).select("src", "dst")


def _labels(prints: DataFrame, radius: int) -> DataFrame:
    """(fp, copies, root long, component_id long) of each distinct fingerprint of ``prints`` (doc_id, fp); root names the component."""
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")))
    # The node of a fingerprint is the fingerprint itself, so rows repeating a doc_id under two fingerprints stay apart.
    found = connected_components(link_near(nodes.select(F.col("fp").alias("node"), "fp"), radius))
    joined = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "copies", "least", F.coalesce("component", "fp").alias("root"))
    roots = joined.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    return cut(spread_join(joined, roots, "root", "n").select("fp", "copies", "root", "component_id"))


def near_duplicates(docs: DataFrame, radius: int = 2, words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id long, fp long, component_id long), one row per row of ``docs``.

    component_id is the smallest doc_id reachable by links of at most ``radius`` bits, the document's own included. Equal
    fingerprints meet before any link is sought, so a group of copies of any size is one node. Rows that repeat a doc_id are
    rows of one node only if their fingerprints link. A null doc_id is no label: its row takes the component of its
    fingerprint, null if only null ids carry it and nothing links to it. An empty table gives no rows.
    """
    prints = cut(fingerprints(docs, words, seed))
    return spread_join(prints, _labels(prints, radius).drop("root"), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, radius: int = 2, words: int = 3, seed: int = 42) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest doc_id (rows without one come last), among those the one with the
    smallest hash of id and text. All columns stay.

    Rows repeating a doc_id with unlinked texts are of different components and each stays. Rows equal in id and text are one;
    of their other columns those of the row with the smallest hash of all columns stay. An empty table gives no rows.
    """
    if "doc_id" not in docs.columns:
        raise ValueError("documents need a doc_id")
    doc_id = F.col("doc_id").cast("long")
    key = F.xxhash64(doc_id, F.col("text").cast("string"))
    prints = cut(fingerprints(docs, words, seed, keyed=True))
    labels = _labels(prints, radius).select("fp", "root")
    first = F.min(F.struct(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)).alias("i"), "key")).alias("first")
    # The best of each fingerprint first, so that copies are settled before anything is joined.
    best = prints.groupBy("fp").agg(first).join(labels, "fp").groupBy("root").agg(F.min("first").alias("first"))
    chosen = best.select(F.col("first.i").alias("i"), F.col("first.key").alias("key"))
    own = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.coalesce(doc_id, F.lit(0)).alias("i"), key.alias("key"), F.xxhash64(*own).alias("by"), F.struct(*own).alias("row"))
    once = rows.join(chosen, ["i", "key"], "left_semi").groupBy("i", "key").agg(F.min_by("row", "by").alias("row"))
    return once.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
