"""MissForest over long tables: columns lie in files of the shared folder, a task grows one tree of a feature's forest, another settles the feature."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from assayloom.operators.forest import Shape, Tree, grow
from assayloom.runtime import kept, shared_folder

#: Cells of the rows that a task turns into columns.
BLOCK = 1 << 20


def folder_of_columns(spark: SparkSession) -> str | None:
    """Where columns may lie: the shared folder, if it is on a file system of the machines."""
    folder = urlparse(shared_folder(spark))
    return unquote(folder.path) if folder.scheme in ("", "file") else None


def _saved(folder: str, values: np.ndarray) -> str:
    """A file of its own for each attempt of a task, so a column once named never changes."""
    path = f"{folder}/column-{uuid.uuid4().hex}.npy"
    np.save(path, values)
    return path


@lru_cache(256)
def _mapped(path: str) -> np.ndarray:
    return np.load(path, mmap_mode="r").view(np.ndarray)


@dataclass(frozen=True)
class Column:
    """The files of a feature's values, gaps filled, and of the rows in their order."""

    values: str
    order: str

    @classmethod
    def of(cls, folder: str, values: np.ndarray) -> Column:
        return cls(_saved(folder, values), _saved(folder, values.argsort(kind="stable").astype(np.int32)))

    def remove(self) -> None:
        for path in (self.values, self.order):
            os.unlink(path)


def tree_of(columns: list[Column], j: int, learn: np.ndarray, depth: int, seed: int, t: int) -> tuple[Tree, list[int]]:
    """Tree ``t`` of the forest of feature ``j`` and the features it numbers. It learns from draws of the rows ``learn``, with replacement, and only
    rows that are drawn are taken out of the columns. Draws depend on the feature and the tree only, so trees need not wait for each other."""
    rng, others = np.random.default_rng([seed + j, t]), [c for c in range(len(columns)) if c != j]
    times = np.bincount(rng.integers(0, len(learn), len(learn)), minlength=len(learn))
    drawn = np.flatnonzero(times)
    rows, times, size = learn[drawn], times[drawn], len(drawn)
    y = _mapped(columns[j].values)
    inside, place = np.zeros(len(y), bool), np.zeros(len(y), np.int32)
    inside[rows], place[rows] = True, np.arange(size)
    x, orders = np.empty((len(others), size)), np.empty((len(others), size), np.int32)
    codes = np.zeros(orders.shape, np.uint16 if size <= 1 << 16 else np.uint32)
    for i, c in enumerate(others):
        _mapped(columns[c].values).take(rows, out=x[i], mode="clip")
        order = _mapped(columns[c].order)
        place.take(order.take(np.flatnonzero(inside.take(order))), out=orders[i], mode="clip")
        order = orders[i].astype(np.intp)
        v = x[i].take(order)
        codes[i, order[1:]] = np.cumsum(v[1:] > v[:-1])
    mtry = max(1, int(np.sqrt(len(others))))
    return grow(x.T, -y[rows], np.ones(size), Shape(depth), rng=rng, mtry=mtry, known=(codes, orders), sample=np.repeat(np.arange(size), times), gaps=False), others


def _asked(columns: list[Column], tree: Tree, others: list[int], gaps: np.ndarray) -> np.ndarray:
    """What a tree says of the rows with gaps; only columns that it splits on are read."""
    b = np.zeros((len(others), len(gaps)))
    for f in np.unique(tree.feature[tree.feature >= 0]):
        b[f] = _mapped(columns[others[f]].values).take(gaps)
    return tree.predict(b.T)


def miss_forest_by_trees(own: DataFrame, keep: list[str], width: int, cells: int, folder: str, rounds: int, trees: int, depth: int, seed: int) -> DataFrame:
    """The rounds of ``impute._rounds`` by forests, over rows (id, ``keep``, x, __own) of ``width`` values; regressions, means, order and when to stop are those
    of the rows that are not __own, if there are any. A job a feature and round: features wait for each other, as each learns from those completed before."""
    table = kept(own.repartitionByRange(max(1, -(-cells // BLOCK)), "id").sortWithinPartitions("id"))
    sc = table.sparkSession.sparkContext

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, mine = [np.empty((0, width))], [np.empty(0, bool)]
        for batch in batches:
            x.append(pc.fill_null(batch.column("x").flatten().cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False).reshape(-1, width))
            mine.append(batch.column("__own").to_numpy(zero_copy_only=False))
        x, mine = np.concatenate(x), np.concatenate(mine)
        out = {"part": TaskContext.get().partitionId(), "n": len(x), "mine": int(mine.sum()), "infinite": bool(np.isinf(x).any()), "x": _saved(folder, np.ascontiguousarray(x.T)), "own": _saved(folder, mine)}
        yield pa.RecordBatch.from_pylist([out])

    parts = sorted(table.select("x", "__own").mapInArrow(blocks, "part long, n long, mine long, infinite boolean, x string, own string").collect())
    if any(p.infinite for p in parts):
        raise ValueError("infinite values cannot be imputed")
    all_mine = all(p.mine == p.n for p in parts)
    owns, n = [p.own for p in parts], sum(p.n for p in parts)

    def teach() -> np.ndarray:
        return np.ones(n, bool) if all_mine else ~np.concatenate([_mapped(p) for p in owns])

    def begin(j: int) -> tuple[Column, str, int, int, bool]:
        v, teaching = np.concatenate([_mapped(p.x)[j] for p in parts]), teach()
        gone = np.isnan(v)
        seen = bool((teaching & ~gone).any())
        filled = np.where(gone, np.nanmean(v[teaching]) if seen else 0.0, v)
        return Column.of(folder, filled), _saved(folder, np.flatnonzero(gone).astype(np.int32)), int(gone.sum()), int((gone & teaching).sum()), seen

    begun = sc.parallelize(range(width), width).map(begin).collect()
    for p in parts:
        os.unlink(p.x)
    now, gaps = [b[0] for b in begun], [b[1] for b in begun]
    felt = sum(b[3] for b in begun)

    def completed(columns: list[Column], j: int) -> tuple[Column, float, float]:
        """Feature ``j`` completed by a forest on the others, and the sums of squares of what changed and what is there now."""

        def grown(t: int) -> tuple[int, np.ndarray]:
            rows, learn = _mapped(gaps[j]), teach()
            learn[rows] = False
            return t, _asked(columns, *tree_of(columns, j, np.flatnonzero(learn), depth, seed, t), rows)

        def settled(said: Iterator[tuple[int, np.ndarray]]) -> Iterator[tuple[Column, float, float]]:
            said, rows, values = dict(said), _mapped(gaps[j]), _mapped(columns[j].values).copy()
            fill = 1 / max(1, trees) * sum((said[t] for t in range(trees)), np.zeros(len(rows)))
            at = teach()[rows]
            moved, size = ((fill - values[rows])[at] ** 2).sum(), (fill[at] ** 2).sum()
            values[rows] = fill
            yield Column.of(folder, values), float(moved), float(size)

        return sc.parallelize(range(trees), max(1, min(trees, sc.defaultParallelism))).map(grown).partitionBy(1).mapPartitions(settled).collect()[0]

    last = np.inf
    for _ in range(rounds):
        new, moved, size = list(now), 0.0, 0.0
        for j in np.argsort([b[3] for b in begun], kind="stable").tolist():
            if begun[j][2] and begun[j][4]:
                new[j], m, s = completed(new, j)
                moved, size = moved + m, size + s
        change = moved / max(size, 1e-300) if felt else last
        stop = bool(felt) and change >= last
        for old in {*(new if stop else now)} - {*(now if stop else new)}:
            old.remove()
        if stop:
            break
        last, now = change, new
        if change < 1e-6 or not any(b[2] for b in begun):
            break
    starts = dict(zip([p.part for p in parts], np.cumsum([0, *(p.n for p in parts)]).tolist(), strict=False))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = starts[TaskContext.get().partitionId()] if (batches := list(batches)) else 0
        for batch in batches:
            n = batch.num_rows
            x = np.stack([_mapped(c.values)[start : start + n] for c in now], axis=1)
            filled = pa.ListArray.from_arrays(np.arange(0, n * width + 1, width, dtype=np.int32), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), filled], [*keep, "x"]).filter(batch.column("__own"))
            start += n

    kinds = ", ".join(f"`{c}` {t}" for c, t in table.select(*keep).dtypes)
    return table.select(*keep, "__own").mapInArrow(rows, f"{kinds}, x array<double>")
