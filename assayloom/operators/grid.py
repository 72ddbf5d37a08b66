"""Grids of fits over one short matrix: it is sent to all workers once, after a check of its size, and a task gets the numbers of its fits."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from assayloom.operators.folds import repeated_stratified_folds, shuffle_splits
from assayloom.runtime import shared_folder

#: Cells of a matrix that is sent to the workers; larger ones raise.
MOST_CELLS = 50_000_000
#: Cells from which on workers share one mapped file.
LEAST_STORED = 1 << 20


@dataclass(frozen=True)
class Matrix:
    """Rows in the order of their ids; missing values are nan. One that has a ``path`` travels without its values, which all workers of a
    machine read from there as one mapped file."""

    ids: np.ndarray
    x: np.ndarray
    y: np.ndarray
    path: str | None = None

    def __reduce__(self):
        return (_mapped, (self.ids, self.path, self.y)) if self.path else (Matrix, (self.ids, self.x, self.y))


def _mapped(ids: np.ndarray, path: str, y: np.ndarray) -> Matrix:
    return Matrix(ids, np.load(path, mmap_mode="r").view(np.ndarray), y, path)


def _stored(spark: SparkSession, x: np.ndarray) -> str | None:
    """Where the values lie in the shared folder, if that is on a file system of the machines; elsewhere they travel with the rest."""
    folder = urlparse(shared_folder(spark))
    if x.size < LEAST_STORED or folder.scheme not in ("", "file"):
        return None
    path = f"{unquote(folder.path)}/matrix-{uuid.uuid4().hex}.npy"
    np.save(path, x)
    return path


def matrix_of(arrays: DataFrame, most_cells: int = MOST_CELLS) -> Matrix:
    """Of (id, target, x array<double>) with equally long arrays."""
    rows = arrays.select("id", "target", "x")
    first = rows.first()
    n = rows.count()
    width = len(first.x) if first else 0
    if n * width > most_cells:
        raise ValueError(f"{n * width} cells are more than the {most_cells} that are sent to the workers; select features or rows first")
    table = rows.toArrow().sort_by("id")
    column = table["x"].combine_chunks()
    x = pc.fill_null(column.flatten(), np.nan).to_numpy(zero_copy_only=False).astype(float).reshape(n, width)
    return Matrix(table["id"].to_numpy(), x, table["target"].to_numpy(), _stored(rows.sparkSession, x))


def _by_row(m: Matrix, table: pa.Table, column: str, repeats: int) -> np.ndarray:
    out = np.zeros((repeats, len(m.ids)), np.int64)
    out[table["repeat"].to_numpy(), np.searchsorted(m.ids, table["id"].to_numpy())] = pc.cast(table[column], pa.int64()).to_numpy()
    return out


def folds_of(m: Matrix, arrays: DataFrame, k: int, repeats: int, seed: int) -> np.ndarray:
    """The test fold of each row, a line a repeat."""
    return _by_row(m, repeated_stratified_folds(arrays.select("id", "target"), k, repeats, seed).select("repeat", "id", "fold").toArrow(), "fold", repeats)


def splits_of(m: Matrix, arrays: DataFrame, splits: int, test: float, seed: int) -> np.ndarray:
    """Whether each row is tested, a line a split."""
    return _by_row(m, shuffle_splits(arrays.select("id"), splits, test, seed).select("repeat", "id", "test").toArrow(), "test", splits).astype(bool)


def grid(spark: SparkSession, shared: object, keys: list[tuple], fit: Callable[..., pd.DataFrame | Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """What ``fit(shared, *key)`` gives for every key, at once or one after the other; ``shared`` is sent once."""
    sent = spark.sparkContext.broadcast((shared, keys))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shared, keys = sent.value
        for pdf in parts:
            for i in pdf["id"]:
                found = fit(shared, *keys[i])
                yield from (found,) if isinstance(found, pd.DataFrame) else found

    tasks = max(1, min(len(keys), 4 * spark.sparkContext.defaultParallelism))
    return spark.range(0, len(keys), 1, tasks).mapInPandas(run, schema)
