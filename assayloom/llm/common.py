"""What the operators of this subpackage share: the shared work folder, lineage cuts, column picks and text scanning.

Words are ``[^\\x20\\x09-\\x0D]+`` on the UTF-8 bytes of a text, which is what ``bytes.split()`` cuts.
"""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

#: Bytes of text that one vectorised step works on; arrays of 8 bytes a text byte stay small.
CHUNK_BYTES = 1 << 19


def work_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names. Where the session names none, a local master gets a local one (tests); others raise,
    since their executors would each write to a disk of their own."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="assayloom-"))
        named = sc._jsc.sc().getCheckpointDir().get()
    elif sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder; plans after it start there."""
    work_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Keys that a larger share of the rows than one in so many carries are met by broadcast; there are at most as many.
HOT_KEYS = 1024


def spread_join(rows: DataFrame, table: DataFrame, keys: str | list[str], copies: str = "copies", how: str = "inner", total: int | None = None) -> DataFrame:
    """``rows`` joined by ``keys`` with ``table``, which has each key once and in ``copies`` how many rows carry it (that column goes).

    A key with more than one row in HOT_KEYS is met where its rows are: HOT_KEYS such rows of ``table`` at most are sent to all
    tasks, and only rows with other keys are shuffled, so no task gets more of a hot key than its share. Null keys meet none.
    ``total`` is the sum of ``copies``, or less than a few times it, where the caller knows it.
    """
    keys = [keys] if isinstance(keys, str) else keys
    total = (table.agg(F.sum(copies)).first()[0] or 0) if total is None else total
    hot, cold = (table.filter(f).drop(copies) for f in (F.col(copies) * HOT_KEYS > total, F.col(copies) * HOT_KEYS <= total))
    marked = rows.join(F.broadcast(hot.select(*keys, F.lit(True).alias("__hot"))), keys, "left")
    near = marked.filter("__hot").drop("__hot").join(F.broadcast(hot), keys)
    return near.unionByName(marked.filter("__hot is null").drop("__hot").join(cold, keys, how))


#: Bytes of a shuffle's partition where a size is known.
PART_BYTES = 128 << 20


def dealt(df: DataFrame, keys: list[str], size: int) -> DataFrame:
    """``df`` in partitions by ``keys`` of about PART_BYTES, if its ``size`` in bytes asks for more than the session's number; else as it
    is, and the operation that follows deals it out by those keys."""
    parts = -(-size // PART_BYTES)
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def pick(df: DataFrame, **kinds: str) -> DataFrame:
    """Only the named columns, cast; further columns, whatever their names, are left behind."""
    return df.select(*(F.col(f"`{c}`").cast(kind).alias(c) for c, kind in kinds.items()))


def tidy() -> None:
    """Memory that is free goes back to the system. Workers live on from task to task, and what one task needed would stay with them."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU C library
        trim(0)


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of the batches whose texts have about ``most`` bytes together (a longer text makes a slice of its own). Tidies up in the end."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
        ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < n:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(start, stop - start), column.slice(start, stop - start).to_pylist()
            start = stop
    tidy()


def dense(column: pa.ChunkedArray | pa.Array, width: int, kind: type = np.float64) -> np.ndarray:
    """A column of lists without nulls as a matrix, shorter lists followed by zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), width), kind)
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The XXH3 hash of each word of the texts as two 64-bit halves, in two columns, and each text's number of words."""
    words = [(t or b"").split() for t in texts]
    raw = b"".join(map(xxhash.xxh3_128_digest, chain.from_iterable(words)))
    return np.frombuffer(raw, "<u8").reshape(-1, 2), np.fromiter(map(len, words), np.int64, len(words))


def _follow(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of what ``a`` stands for followed by what ``b`` stands for."""
    return mix(a * np.uint64(0x8CB92BA72F3D8DD7) + (b ^ (b >> np.uint64(29))) * np.uint64(0xD1342543DE82EF95))


def run_hashes(words: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """64-bit hashes of the ``length`` words from each of the positions ``at``, from one half of the words' hashes.

    Runs of twice the length are hashed from two halves, up to the largest power of two; the run asked for is hashed from two
    of those, which overlap. No step is linear, so long regular sequences are as good as any other.
    """
    h, size = words, 1
    while 2 * size <= length:
        h = _follow(h[:-size], h[size:])
        size *= 2
    return _follow(h[at], h[at + (length - size)]) if size < length else h[at]
