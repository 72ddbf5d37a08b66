"""k nearest neighbours of the rows of a wide matrix: candidates in blocks of near ones, rows sent to the blocks that may hold their best."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayloom.runtime import kept

#: What is offered for rows (ids, matrix) by candidates (ids, matrix).
Kernel = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], list[tuple]]

#: Rows of a block of queries and of a block of candidates; a task compares one of each.
BLOCK, OTHERS = 4096, 2048
#: Queries compared at once.
STEP = 256
#: Rows of a block where all blocks meet all, and candidates that single precision looks through at once.
DENSE, WIDE = 1 << 16, 4096
#: Rows that say whether blocks can be ruled out, and the share of blocks asked beyond which all meet all.
TRIED, MOST_ASKED = 64, 0.125


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    width = pc.max(pc.list_value_length(column)).as_py() or 0
    return pc.fill_null(column.flatten(), np.nan).to_numpy(zero_copy_only=False).astype(float).reshape(len(column), width)


def masked_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances over the coordinates both rows have, scaled up to all of them; nan where they share none."""
    ma, mb = ~np.isnan(a), ~np.isnan(b)
    x, y = np.where(ma, a, 0), np.where(mb, b, 0)
    both = ma.astype(float) @ mb.T.astype(float)
    d = (x**2) @ mb.T.astype(float) + ma.astype(float) @ (y**2).T - 2 * x @ y.T
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(both > 0, np.sqrt(np.maximum(d, 0) * a.shape[1] / both), np.nan)


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(size > 0, 1 - a @ b.T / size, np.nan)


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return a / b


#: Rows and columns of distances that are made together, in buffers that stay in a core's cache.
TILE = (32, 1024)


def _summed(a: np.ndarray, b: np.ndarray, term: Callable[..., None], join: Callable = np.add) -> np.ndarray:
    """What ``term(u, v, out, spare)`` writes of each feature, u of the rows of ``a`` and v of those of ``b``, joined feature by feature."""
    kind = np.result_type(a, b, np.float32)
    high = TILE[0] * 8 // kind.itemsize
    out, at, bt = np.zeros((len(a), len(b)), kind), np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    for r in range(0, len(a), high):
        for c in range(0, len(b), TILE[1]):
            total = out[r : r + high, c : c + TILE[1]]
            own, one, spare = np.zeros(total.shape, kind), np.empty(total.shape, kind), np.empty(total.shape, kind)
            for u, v in zip(at[:, r : r + high, None], bt[:, c : c + TILE[1]], strict=True):
                term(u, v, one, spare)
                join(own, one, out=own)
            total[:] = own
    return out


def _off(u: np.ndarray, v: np.ndarray, out: np.ndarray, spare: np.ndarray) -> None:
    np.abs(np.subtract(u, v, out=out), out=out)


def _squared(u: np.ndarray, v: np.ndarray, out: np.ndarray, spare: np.ndarray) -> None:
    np.square(np.subtract(u, v, out=out), out=out)


def _cubed(u: np.ndarray, v: np.ndarray, out: np.ndarray, spare: np.ndarray) -> None:
    _off(u, v, spare, out)
    np.multiply(np.square(spare, out=out), spare, out=out)


def _share(u: np.ndarray, v: np.ndarray, out: np.ndarray, spare: np.ndarray) -> None:
    """A coordinate that both rows have at 0 adds nothing."""
    _off(u, v, out, spare)
    np.divide(out, np.add(np.abs(u), np.abs(v) + np.finfo(out.dtype).smallest_subnormal, out=spare), out=out)


def _canberra(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if np.isfinite(a).all() and np.isfinite(b).all():
        return _summed(a, b, _share)
    return np.nan_to_num(_ratio(np.abs(a[:, None] - b[None]), np.abs(a)[:, None] + np.abs(b)[None])).sum(axis=2)


def _bray_curtis(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _ratio(_summed(a, b, _off), _summed(a, -b, _off))


def _unlike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many features differ; counted in bytes, as many features at a time as one holds. Values that single precision has are compared there."""
    with np.errstate(over="ignore"):
        single = [v.astype(np.float32) for v in (a, b)]
    if (single[0] == a).all() and (single[1] == b).all():
        a, b = single
    out, at, bt = np.zeros((len(a), len(b)), np.int64), np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    for r in range(0, len(a), TILE[0]):
        for c in range(0, len(b), TILE[1]):
            total = out[r : r + TILE[0], c : c + TILE[1]]
            for s in range(0, len(at), 255):
                own, one = np.zeros(total.shape, np.uint8), np.empty(total.shape, bool)
                for u, v in zip(at[s : s + 255, r : r + TILE[0], None], bt[s : s + 255, c : c + TILE[1]], strict=True):
                    np.add(own, np.not_equal(u, v, out=one).view(np.uint8), out=own)
                total += own
    return out


def _sets(of: Callable[..., np.ndarray]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A distance of rows taken as sets, of what is not 0 in them: from how many features are in both, in one, and how many there are."""

    def run(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        u, v = (a != 0).astype(float), (b != 0).astype(float)
        both = u @ v.T
        return of(both, u.sum(axis=1)[:, None] + v.sum(axis=1)[None, :] - 2 * both, a.shape[1])

    return run


#: Distances of sets. They grow with what is in one alone and fall with what is in both, so at least r features in one alone bound them.
SETS: dict[str, Callable[..., np.ndarray]] = {
    "jaccard": lambda both, one, n: np.nan_to_num(_ratio(one, both + one)),
    "dice": lambda both, one, n: np.nan_to_num(_ratio(one, 2 * both + one)),
    "rogerstanimoto": lambda both, one, n: 2 * one / (n + one),
    "sokalsneath": lambda both, one, n: np.nan_to_num(_ratio(2 * one, both + 2 * one)),
    "russellrao": lambda both, one, n: (n - both) / n,
}


#: Distances by name, of every row of one matrix to every row of another; all but the first need complete rows. Minkowski's is of order 3.
METRICS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "masked_euclidean": masked_distances,
    "euclidean": lambda a, b: np.sqrt(np.maximum((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1) - 2 * a @ b.T, 0)),
    "manhattan": lambda a, b: _summed(a, b, _off),
    "chebyshev": lambda a, b: _summed(a, b, _off, np.maximum),
    "cosine": _cosine,
    "correlation": lambda a, b: _cosine(a - a.mean(axis=1, keepdims=True), b - b.mean(axis=1, keepdims=True)),
    "sqeuclidean": lambda a, b: _summed(a, b, _squared),
    "minkowski": lambda a, b: np.cbrt(_summed(a, b, _cubed)),
    "canberra": _canberra,
    "braycurtis": _bray_curtis,
    "hamming": lambda a, b: _unlike(a, b) / a.shape[1],
    **{name: _sets(of) for name, of in SETS.items()},
}


def distances(a: np.ndarray, b: np.ndarray, metric: str = "masked_euclidean") -> np.ndarray:
    if metric not in METRICS:
        raise ValueError(f"metric: {metric!r} is none of {', '.join(METRICS)}")
    return METRICS[metric](a, b)


def _smallest(d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of the ``k`` smallest of each row of ``d``, equal ones by id; nan is none. Rows are only sorted as far as the kth goes."""
    d = np.where(np.isnan(d), np.inf, d)
    kth = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
    near = (d <= (kth + 1e-11 + np.abs(kth) * 1e-11)[:, None]) & np.isfinite(d)  # what may round to the kth
    if np.count_nonzero(near) > 4 * k * len(d):  # of many that equal it the first by id
        by_id, level = np.argsort(ids, kind="stable"), d == kth[:, None]
        near &= ~level
        found, wanted = np.zeros((len(d), 1), np.int64), np.minimum(k, np.count_nonzero(level, axis=1))[:, None]
        for s in range(0, d.shape[1], WIDE):
            at = by_id[s : s + WIDE]
            some = level[:, at]
            near[:, at] |= some & (np.cumsum(some, axis=1, dtype=np.int32) + found <= k)
            found += np.count_nonzero(some, axis=1)[:, None]
            if (found >= wanted).all():
                break
    row, place = np.nonzero(near)
    order = np.lexsort((ids[place], np.round(d[row, place], 12), row))
    row, place = row[order], place[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < k], place[rank < k]


#: Blocks of candidates, and numbers that the summaries of all of them hold together, at most; more rows make larger blocks.
MOST_BLOCKS, SUMMARY = 4096, 1 << 22


class _Summaries:
    """What is known of every block of candidates: the range of each coordinate among its rows, and how few of them a row has."""

    def __init__(self, block: np.ndarray, low: np.ndarray, high: np.ndarray, least: np.ndarray, counts: np.ndarray):
        self.block, self.low, self.high, self.least, self.counts = block, low, high, least, counts

    def bounds(self, x: np.ndarray, metric: str) -> np.ndarray:
        """No row of a block (a column each) is nearer to the rows of ``x`` than this. Where coordinates are missing a distance is a
        mean over those shared, so the bound is that of as few as may be, the nearest ones."""
        x = _spread(x, metric)
        out = np.empty((len(x), len(self.block)))
        for r, row in enumerate(x):
            off = np.maximum(np.maximum(self.low - row, row - self.high), 0)  # infinite where a block has no such coordinate, nan where the row has none
            if metric == "chebyshev":
                out[r] = off.max(axis=1)
            elif metric == "manhattan":
                out[r] = off.sum(axis=1)
            elif metric == "sqeuclidean":
                out[r] = (off**2).sum(axis=1)
            elif metric == "minkowski":
                out[r] = np.cbrt((off**3).sum(axis=1))
            elif metric == "canberra":  # least at the end that is nearer
                out[r] = np.nan_to_num(_ratio(off, np.abs(row) + np.abs(np.clip(row, self.low, self.high)))).sum(axis=1)
            elif metric == "braycurtis":
                out[r] = _ratio(off.sum(axis=1), np.maximum(np.abs(row + self.low), np.abs(row + self.high)).sum(axis=1))
            elif metric == "hamming":
                out[r] = (off > 0).mean(axis=1)
            elif metric in SETS:  # features that all rows of the block have and this one does not, or the other way
                out[r] = SETS[metric](len(row) - off.sum(axis=1), off.sum(axis=1), len(row))
            elif metric == "masked_euclidean":
                shared = np.maximum(1, (~np.isnan(row)).sum() + self.least - len(row))
                near = np.sort(np.where(np.isnan(off), np.inf, off) ** 2, axis=1)
                out[r] = np.sqrt(len(row) * np.take_along_axis(np.cumsum(near, axis=1), shared[:, None] - 1, axis=1)[:, 0] / shared)
            else:
                out[r] = np.sqrt((off**2).sum(axis=1)) if metric == "euclidean" else (off**2).sum(axis=1) / 2
        return np.where(np.isnan(out), 0, out) * (1 - 1e-9)


def _spread(x: np.ndarray, metric: str) -> np.ndarray:
    """Rows whose Euclidean distances give those of the metric; of sets, what is in them."""
    if metric in SETS:
        return (x != 0).astype(float)
    if metric == "correlation":
        x = x - x.mean(axis=1, keepdims=True)
    if metric in ("cosine", "correlation"):
        with np.errstate(invalid="ignore", divide="ignore"):
            return x / np.linalg.norm(x, axis=1, keepdims=True)
    return x


def _placed(other: DataFrame, metric: str) -> tuple[DataFrame, _Summaries | None]:
    """(id, x, block) of the candidates, near ones together: with the nearest of some of them, a row in OTHERS. Where many are with the
    same one, blocks are parts of its rows."""
    n = other.count()
    width = (other.select(F.max(F.size("x"))).first()[0] or 1) if n > OTHERS else 1
    cells = min(-(-n // OTHERS), MOST_BLOCKS, max(1, SUMMARY // width))
    if cells <= 1:
        return other.select("id", "x", F.lit(0).cast("long").alias("block")), None
    chosen = other.select("id", "x").orderBy(F.xxhash64("id"), "id").limit(cells).collect()
    pivots = np.array([[np.nan if v is None else v for v in r.x] for r in chosen], float)

    def place(batches):
        for batch in batches:
            x = _matrix(pa.chunked_array([batch.column("x")])) if batch.num_rows else np.zeros((0, width))
            cell = np.concatenate([np.argmin(np.nan_to_num(distances(x[s : s + STEP], pivots, metric), nan=np.inf), axis=1) for s in range(0, len(x), STEP)]) if len(x) else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int64())], ["id", "x", "cell"])

    placed = kept(other.select("id", "x").mapInArrow(place, "id long, x array<double>, cell long"))
    size = -(-n // cells) * 2
    parts = placed.groupBy("cell").agg(F.ceil(F.count("*") / size).alias("parts"))  # a row a pivot
    cut = placed.join(F.broadcast(parts), "cell").select("id", "x", (F.col("cell") * (1 << 32) + F.pmod(F.xxhash64("id"), F.col("parts"))).alias("block"))

    def ranges(table: pa.Table) -> pa.Table:
        raw = _matrix(table["x"])
        x = _spread(raw, metric)
        there = ~np.isnan(x)
        low, high = np.where(there, x, np.inf).min(axis=0), np.where(there, x, -np.inf).max(axis=0)
        return pa.table({"block": pa.array([table["block"][0].as_py()], pa.int64()), "low": pa.array([low.tolist()]), "high": pa.array([high.tolist()]), "least": pa.array([int(there.sum(axis=1).min())], pa.int64()), "counts": pa.array([(~np.isnan(raw)).sum(axis=0).tolist()])})

    found = cut.groupBy("block").applyInArrow(ranges, "block long, low array<double>, high array<double>, least long, counts array<long>").orderBy("block").collect()  # SUMMARY numbers
    return cut, _Summaries(*(np.array([r[c] for r in found]) for c in ("block", "low", "high", "least", "counts")))


class _Sieve:
    """Candidates in single precision, which passes on those that may be as near as a limit: all that are, by a bound of what rounding
    does, and few more. Distances themselves are made in doubles, of what is passed on."""

    def __init__(self, x: np.ndarray):
        self.x, self.width, self.there = x, x.shape[1], ~np.isnan(x)
        size = np.where(self.there, np.abs(x), 0).max(initial=0)
        self.sound = bool(size < 1e15)
        count = self.there.sum(axis=0)
        self.centre = np.where(self.there, x, 0).sum(axis=0) / np.maximum(1, count) if self.sound else np.zeros(self.width)
        y = np.where(self.there, x - self.centre, 0)
        self.far, self.made, self.y, self.gaps = float(np.sqrt((y**2).sum(axis=1).max(initial=0))), {}, y, not self.there.all()

    def _side(self, gaps: bool) -> tuple[np.ndarray, np.ndarray]:
        if gaps not in self.made:
            self.made[gaps] = (np.concatenate([self.there, self.y**2, self.y], axis=1).astype(np.float32), self.there.astype(np.float32)) if gaps else (np.concatenate([self.y, (self.y**2).sum(axis=1)[:, None]], axis=1).astype(np.float32), None)
        return self.made[gaps]

    def apart(self, xa: np.ndarray, row: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Distances of pairs; nan where they share no coordinate."""
        out = np.empty(len(row))
        for s in range(0, len(row), 1 << 14):
            off = xa[row[s : s + (1 << 14)]] - self.x[place[s : s + (1 << 14)]]
            both = (~np.isnan(off)).sum(axis=1)
            with np.errstate(invalid="ignore", divide="ignore"):
                out[s : s + (1 << 14)] = np.sqrt(np.nansum(off**2, axis=1) * self.width / both)
        return out

    def passed(self, ida: np.ndarray, xa: np.ndarray, idb: np.ndarray, first: Callable, settle: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place, distance) that ``settle`` leaves: it is given those found so far, gives which of them to keep and how far each row
        still looks. ``first`` gives places to begin with for each row."""
        ma = ~np.isnan(xa)
        gaps = self.gaps or not ma.all()
        x0 = np.where(ma, xa - self.centre, 0)
        size = (x0**2).sum(axis=1)
        left = np.concatenate([x0**2, ma, -2 * x0], axis=1).astype(np.float32) if gaps else np.concatenate([-2 * x0, np.ones((len(xa), 1))], axis=1).astype(np.float32)
        right, there = self._side(gaps)
        mask, slack = ma.astype(np.float32), (3 * self.width + 32) * 2.0**-23 * (np.sqrt(size) + self.far) ** 2
        by_id = np.argsort(idb, kind="stable")
        low, high = np.searchsorted(idb[by_id], ida), np.searchsorted(idb[by_id], ida, "right")
        own = {(r, int(by_id[p])) for r in np.flatnonzero(high > low) for p in range(low[r], high[r])}
        row, place = first()
        row, place, d, limit = self._settled(xa, row, place, np.zeros(0), settle, own)
        waiting: list[tuple] = []
        buffer, other = np.empty((len(xa), WIDE), np.float32), np.empty((len(xa), WIDE), np.float32)
        for c in range(0, len(self.x), WIDE):
            part = slice(c, min(c + WIDE, len(self.x)))
            found = np.matmul(left, right[part].T, out=buffer[:, : part.stop - c])
            with np.errstate(over="ignore"):
                bound = np.minimum(limit**2, 1e30) * (1 + 1e-5)
            if gaps:
                most = np.matmul(mask, there[part].T, out=other[:, : part.stop - c])
                most *= (bound / self.width)[:, None].astype(np.float32)
                most += slack[:, None].astype(np.float32)
                hit = found <= most
            else:
                hit = found <= (bound - size + slack)[:, None].astype(np.float32)
            r, p = np.divmod(np.flatnonzero(hit), part.stop - c)
            waiting.append((r, p + c))
            if sum(len(w[0]) for w in waiting) > 16 * len(xa) or part.stop == len(self.x):
                r, p = (np.concatenate(w) for w in zip(*waiting, strict=True))
                row, place, d, limit = self._settled(xa, np.concatenate([row, r]), np.concatenate([place, p]), d, settle, own)
                waiting = []
        return row, place, d

    def _settled(self, xa: np.ndarray, row: np.ndarray, place: np.ndarray, d: np.ndarray, settle: Callable, own: set) -> tuple:
        fresh = np.ones(len(row), bool)
        fresh[: len(d)] = False
        _, once = np.unique(row * len(self.x) + place, return_index=True)  # the earlier of equal pairs
        d = np.concatenate([d, self.apart(xa, row[fresh], place[fresh])])
        row, place, d = row[once], place[once], d[once]
        for r, p in own:
            d[(row == r) & (place == p)] = np.nan
        there = ~np.isnan(d)
        keep, limit = settle(row[there], place[there], d[there])
        return row[there][keep], place[there][keep], d[there][keep], limit


def _first(group: np.ndarray, d: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` first of each group by rounded distance, then id."""
    order = np.lexsort((ids, np.round(d, 12), group))
    g = group[order]
    return order[np.arange(len(g)) - np.searchsorted(g, g) < k]


#: Candidates whose least distance stands for them where a limit is looked for, and the share of pairs beyond which single precision tells too little.
GROUP, MOST_PASSED = 64, 1 / 64


def _kth_least(d: np.ndarray, k: int) -> np.ndarray:
    """Of each row a limit that at least ``k`` values are within: the kth of the least ones of groups."""
    edge = d.shape[1] // GROUP * GROUP
    least = d[:, :edge].reshape(len(d), -1, GROUP).min(axis=2)
    return np.partition(least, k - 1, axis=1)[:, k - 1].astype(float)


def _pairs(u: np.ndarray, v: np.ndarray, term: Callable[..., None]) -> np.ndarray:
    """What ``_summed`` gives of the pairs of rows alone."""
    own, one, spare = (np.zeros(len(u)) for _ in range(3))
    for a, b in zip(np.ascontiguousarray(u.T), np.ascontiguousarray(v.T), strict=True):
        term(a, b, one, spare)
        own += one
    return own


def _roughly(ida: np.ndarray, xa: np.ndarray, idb: np.ndarray, xb: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(row, place, distance) of all candidates that may be among the ``k`` nearest of each row, their distances in doubles: single precision looks at all
    and passes on those within the limit, with a bound of what rounding does (half of ``unit`` a step). None where it tells too little."""
    size = np.abs(np.concatenate([xa, xb]))
    if len(xb) < GROUP * k or not np.isfinite(size).all() or size.max(initial=0) > 1e9 or size[size > 0].min(initial=1) < 1e-30:
        return None
    a, b, width, unit, own = xa.astype(np.float32), xb.astype(np.float32), xa.shape[1], 2.0**-23, np.nonzero(ida[:, None] == idb[None, :])
    if metric == "canberra":  # terms are 1 at most
        d = _summed(a, b, _share)
        d[own] = np.inf
        limit = _kth_least(d, k) + 2 * unit * width * (width + 16)
        hit = d <= limit[:, None].astype(np.float32)
        apart = lambda u, v: _pairs(u, v, _share)
    elif metric == "minkowski":
        d = _summed(a, b, _cubed)
        d[own] = np.inf
        more, off = unit * (width + 16), unit * 2.1 * float(np.cbrt((size**3).sum(axis=1).max())) + 1e-12
        limit = (np.cbrt(_kth_least(d, k)) * (1 + more) + 2 * off) * (1 + 2 * more)
        hit = d <= (limit**3 * (1 + 1e-5)).astype(np.float32)[:, None]
        apart = lambda u, v: np.cbrt(_pairs(u, v, _cubed))
    else:
        d, under = _summed(a, b, _off), _summed(a, -b, _off)
        off = np.float32(unit * (width + 16) * 2 * size.sum(axis=1).max())
        d[own] = np.inf
        with np.errstate(divide="ignore", invalid="ignore"):
            limit = _kth_least(np.where(under > off, (d + off) / (under - off), np.float32(np.inf)), k) * (1 + 1e-5)
        if not np.isfinite(limit).all():
            return None
        under += off
        hit = d - off <= limit[:, None].astype(np.float32) * under * np.float32(1 + 1e-5)
        apart = lambda u, v: _ratio(_pairs(u, v, _off), _pairs(u, -v, _off))
    place = np.flatnonzero(hit)
    if len(place) > MOST_PASSED * hit.size:
        return None
    row, place = np.divmod(place, hit.shape[1])
    exact = apart(xa[row], xb[place])
    there = np.isfinite(exact) & (ida[row] != idb[place])
    row, place, exact = row[there], place[there], exact[there]
    best = _first(row, exact, idb[place], k)
    return row[best], place[best], exact[best]


def _near(sieve: _Sieve, ida: np.ndarray, xa: np.ndarray, idb: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, distance) of the ``k`` nearest candidates of each row."""

    def settle(row: np.ndarray, place: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keep, limit = _first(row, d, idb[place], k), np.full(len(xa), np.inf)
        full = np.flatnonzero(np.bincount(row[keep], minlength=len(xa)) >= k)
        far = np.zeros(len(xa))
        np.maximum.at(far, row[keep], d[keep])
        limit[full] = far[full] + 1e-11
        return keep, limit

    def first() -> tuple[np.ndarray, np.ndarray]:
        row, place = _smallest(_apart(ida, xa, idb[:1024], sieve.x[:1024]), idb[:1024], k)
        return row, place

    return sieve.passed(ida, xa, idb, first, settle)


def _near_having(sieve: _Sieve, ida: np.ndarray, xa: np.ndarray, idb: np.ndarray, k: int) -> list[tuple]:
    """(id, feature, candidate's id, its value, distance): for each gap the ``k`` nearest candidates that have the feature."""
    gone, having = np.isnan(xa), sieve.there.sum(axis=0)
    often = having > WIDE  # the others' offers are all made first, and say nothing of how far to look

    def offers(row: np.ndarray, place: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hit, fi = np.nonzero(gone[row] & sieve.there[place])
        best = _first(row[hit] * gone.shape[1] + fi, d[hit], idb[place[hit]], k)
        return hit[best], fi[best]

    def settle(row: np.ndarray, place: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hit, fi = offers(row, place, d)
        held, far = np.zeros(gone.shape, np.int64), np.zeros(len(xa))
        np.add.at(held, (row[hit], fi), 1)
        np.maximum.at(far, row[hit], np.where(often[fi], d[hit], 0))
        return np.unique(hit), np.where(((held >= k) | ~gone | ~often).all(axis=1), far + 1e-11, np.inf)

    def first() -> tuple[np.ndarray, np.ndarray]:
        """Of features that few have all of those, else some of the first candidates."""
        begin = _apart(ida, xa, idb[:1024], sieve.x[:1024])
        rows, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for j in np.flatnonzero(gone.any(axis=0) & (having > 0)):
            ask = np.flatnonzero(gone[:, j])
            have = np.flatnonzero(sieve.there[:, j]) if not often[j] else np.flatnonzero(sieve.there[:1024, j])
            if len(have):
                part = _apart(ida[ask], xa[ask], idb[have], sieve.x[have]) if not often[j] else begin[np.ix_(ask, have)]
                row, place = _smallest(part, idb[have], k)
                rows.append(ask[row])
                places.append(have[place])
        return np.concatenate(rows), np.concatenate(places)

    row, place, d = sieve.passed(ida, xa, idb, first, settle)
    hit, fi = offers(row, place, d)
    return [(ida[row[hit]], fi, idb[place[hit]], sieve.x[place[hit], fi], d[hit])]


def _sieves() -> Callable[[np.ndarray], _Sieve]:
    """The sieve of the candidates that were asked for last."""
    held: list[_Sieve] = []

    def of(x: np.ndarray) -> _Sieve:
        if not held or held[0].x is not x:
            held[:] = [_Sieve(x)]
        return held[0]

    return of


def _all_asked(rows: DataFrame, other: DataFrame, seen: _Summaries, metric: str, kernel: Kernel, names: dict[str, pa.DataType], reach: Callable) -> bool:
    """Whether a few of the rows, once they know how far their best are, would ask too many blocks for it to be worth while."""
    few = rows.orderBy(F.xxhash64("id"), "id").limit(TRIED).toArrow()
    ids, x = few["id"].to_numpy(), _matrix(few["x"])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                out = kernel(ids, x, batch.column("id").to_numpy(zero_copy_only=False), _matrix(pa.chunked_array([batch.column("x")])))
                columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for t, v in zip(names.values(), columns, strict=True)], list(names))

    met = other.select("id", "x").mapInArrow(run, _schema(names))
    far = {r["id"]: r["far"] for r in reach(met, seen.counts.sum(axis=0)).collect()}  # TRIED rows
    limits = np.array([np.inf if far.get(i) is None else far[i] for i in ids])
    asked = (seen.bounds(x, metric) <= limits[:, None]).sum(axis=1) - 1
    return bool(asked.mean() > MOST_ASKED * (len(seen.block) - 1))


def _met_densely(rows: DataFrame, other: DataFrame, kernel: Kernel, names: dict[str, pa.DataType]) -> DataFrame:
    """What ``kernel`` gives of all rows and all candidates: DENSE rows at most meet as many candidates in a task, so copies that travel are few."""
    n, m, workers = rows.count(), other.count(), rows.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-m // DENSE))
    size = min(DENSE, max(BLOCK, -(-n * blocks // (4 * workers))))
    dealt = lambda parts: F.pmod(F.xxhash64("id", F.lit(1)), F.lit(parts))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    return met_in_blocks(rows.select("id", "x", every.alias("block")), other.select("id", "x", dealt(blocks).alias("block")), kernel, names, size)


def _schema(names: dict[str, pa.DataType]) -> str:
    kinds = {pa.int64(): "long", pa.float64(): "double"}
    return ", ".join(f"{c} {kinds[t]}" for c, t in names.items())


def met_in_blocks(rows: DataFrame, placed: DataFrame, kernel: Kernel, names: dict[str, pa.DataType], most: int | None = None) -> DataFrame:
    """What ``kernel`` gives of (ids, matrix) of the ``rows`` (id, x, block) and of the candidates of their block. Where many rows ask for a block, they
    are dealt out, ``most`` (default: BLOCK) to a part about, and the block is sent to each part."""
    asked = rows.groupBy("block").agg(F.ceil(F.count("*") / (most or BLOCK)).alias("parts"))  # a row a block
    left = rows.join(F.broadcast(asked), "block").select("id", "x", "block", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part")).toDF("id", "x", "block", "part")
    right = placed.join(F.broadcast(asked), "block").select("id", "x", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).toDF("id", "x", "block", "part")

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(a) and len(b):
            ida, idb, xa, xb = a["id"].to_numpy(), b["id"].to_numpy(), _matrix(a["x"]), _matrix(b["x"])
            for s in range(0, len(ida), STEP):
                out += kernel(ida[s : s + STEP], xa[s : s + STEP], idb, xb)
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[] for _ in names]
        return pa.table({c: pa.array(v, t) for (c, t), v in zip(names.items(), columns, strict=True)})

    return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(run, _schema(names))


def _searched(rows: DataFrame, other: DataFrame, metric: str, kernel: Kernel, names: dict[str, pa.DataType], reach: Callable[[DataFrame, np.ndarray], DataFrame]) -> DataFrame:
    """The kernel's offers, among them the best of all candidates for each of ``rows``.

    A row is first compared with the block it is nearest to. ``reach`` says from those offers how far (id, far) the best may still be, null
    for anywhere; then the row is sent to the other blocks whose summary allows as near a row, and to no more. So among rows in
    clusters the work grows with the rows, not with their pairs; where little can be ruled out, large blocks of rows meet all candidates, and
    what travels is a copy of the table for each of those."""
    rows = rows.select("id", "x")
    placed, seen = _placed(other, metric)
    if seen is None:
        workers = rows.sparkSession.sparkContext.defaultParallelism
        n = rows.count()
        parts = max(1, -(-n // BLOCK), min(workers, -(-n // STEP)))
        spread = rows.select("id", "x", F.pmod(F.xxhash64("id"), F.lit(parts)).alias("block"))  # one block of candidates, for each part of the rows
        return met_in_blocks(spread, placed.select("id", "x", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("block")), kernel, names)

    if _all_asked(rows, other, seen, metric, kernel, names, reach):
        return _met_densely(rows, other, kernel, names)

    def home(batches):
        for batch in batches:
            x = _matrix(pa.chunked_array([batch.column("x")])) if batch.num_rows else np.zeros((0, seen.low.shape[1]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(seen.block[seen.bounds(x, metric).argmin(axis=1)] if len(x) else [], pa.int64())], ["id", "x", "block"])

    def away(batches):
        for batch in batches:
            x = _matrix(pa.chunked_array([batch.column("x")])) if batch.num_rows else np.zeros((0, seen.low.shape[1]))
            far, own = pc.fill_null(batch.column("far"), np.inf).to_numpy(zero_copy_only=False), batch.column("block").to_numpy(zero_copy_only=False)
            row, to = np.nonzero((seen.bounds(x, metric) <= far[:, None]) & (seen.block[None, :] != own[:, None])) if len(x) else (np.zeros(0, int),) * 2
            for s in range(0, len(row), 4096):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[s : s + 4096])), batch.column(1).take(pa.array(row[s : s + 4096])), pa.array(seen.block[to[s : s + 4096]], pa.int64())], ["id", "x", "block"])

    at_home = kept(rows.mapInArrow(home, "id long, x array<double>, block long"))
    first = kept(met_in_blocks(at_home, placed, kernel, names))
    asking = at_home.join(reach(first, seen.counts.sum(axis=0)), "id", "left")
    more = met_in_blocks(kept(asking.select("id", "x", "block", "far").mapInArrow(away, "id long, x array<double>, block long")), placed, kernel, names)
    return first.unionByName(more)


def _apart(ida: np.ndarray, xa: np.ndarray, idb: np.ndarray, xb: np.ndarray, metric: str = "masked_euclidean") -> np.ndarray:
    d = distances(xa, xb, metric)
    d[ida[:, None] == idb[None, :]] = np.nan
    return d


def nearest(rows: DataFrame, k: int, other: DataFrame | None = None, metric: str = "masked_euclidean") -> DataFrame:
    """(id long, nid long, distance double, rank int): the ``k`` rows of ``other`` (default: the same) nearest to each row (id, x
    array<double>) by one of METRICS, ties to the smaller id, a row never its own neighbour."""
    if metric not in METRICS:
        raise ValueError(f"metric: {metric!r} is none of {', '.join(METRICS)}")

    sieve = _sieves()

    def kernel(ida: np.ndarray, xa: np.ndarray, idb: np.ndarray, xb: np.ndarray) -> list[tuple]:
        if metric == "masked_euclidean" and len(xb) > WIDE and sieve(xb).sound:
            row, place, d = _near(sieve(xb), ida, xa, idb, k)
            return [(ida[row], idb[place], d)]
        if metric in ("canberra", "minkowski", "braycurtis") and len(xb) > WIDE and (rough := _roughly(ida, xa, idb, xb, k, metric)):
            row, place, d = rough
            return [(ida[row], idb[place], d)]
        d = _apart(ida, xa, idb, xb, metric)
        row, place = _smallest(d, idb, k)
        return [(ida[row], idb[place], d[row, place])]

    def reach(first: DataFrame, _: np.ndarray) -> DataFrame:
        return first.groupBy("id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("distance")).alias("d")).select("id", F.when(F.col("n") >= k, F.get("d", F.lit(k - 1))).alias("far"))

    found = _searched(rows, rows if other is None else other, metric, kernel, {"id": pa.int64(), "nid": pa.int64(), "distance": pa.float64()}, reach)
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.round("distance", 12), "nid"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def nearest_having(rows: DataFrame, k: int, other: DataFrame | None = None) -> DataFrame:
    """(id long, fi long, value double, distance double): for each missing value of each row (id, x array<double>) the values of the ``k``
    nearest rows of ``other`` (default: the same) that have that feature, ties to the smaller id."""

    sieve = _sieves()

    def kernel(ida: np.ndarray, xa: np.ndarray, idb: np.ndarray, xb: np.ndarray) -> list[tuple]:
        if len(xb) > WIDE and sieve(xb).sound:
            return _near_having(sieve(xb), ida, xa, idb, k)
        d, out = _apart(ida, xa, idb, xb), []
        for j in np.flatnonzero(np.isnan(xa).any(axis=0)):
            ask, have = np.flatnonzero(np.isnan(xa[:, j])), np.flatnonzero(~np.isnan(xb[:, j]))
            if len(have):
                part = d[np.ix_(ask, have)]
                row, place = _smallest(part, idb[have], k)
                out.append((ida[ask[row]], np.full(len(row), j), idb[have[place]], xb[have[place], j], part[row, place]))
        return out

    asking = rows.filter(F.exists("x", lambda v: v.isNull()))

    def reach(first: DataFrame, having: np.ndarray) -> DataFrame:
        """Of a row's gaps the one whose kth offer is farthest; anywhere, while one that can be filled has fewer."""
        wanted = asking.sparkSession.createDataFrame([(j, int(min(k, n))) for j, n in enumerate(having) if n], "fi long, want long")  # a row a feature
        gaps = asking.select("id", F.posexplode("x").alias("fi", "v")).filter("v is null").select("id", F.col("fi").cast("long").alias("fi")).join(F.broadcast(wanted), "fi")
        held = first.groupBy("id", "fi").agg(F.count("*").alias("n"), F.max("distance").alias("d"))
        met = gaps.join(held, ["id", "fi"], "left")
        return met.groupBy("id").agg(F.bool_and(F.coalesce(F.col("n") >= F.col("want"), F.lit(False))).alias("full"), F.max("d").alias("d")).select("id", F.when(F.col("full"), F.col("d")).alias("far"))

    found = _searched(asking, rows if other is None else other, "masked_euclidean", kernel, {"id": pa.int64(), "fi": pa.int64(), "nid": pa.int64(), "value": pa.float64(), "distance": pa.float64()}, reach)
    rank = F.row_number().over(Window.partitionBy("id", "fi").orderBy(F.round("distance", 12), "nid"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank", "nid")


def filled_by_nearest(ids: np.ndarray, x: np.ndarray, own: np.ndarray, wants: list[tuple[int, str]]) -> list[np.ndarray]:
    """A matrix that is in a task already with each gap filled from its nearest rows among ``own``, once for each (k, weights) wanted:
    neighbours are looked for once, as far as the largest k. A gap without any is filled by the feature's mean there, or 0."""
    learn, idl = x[own], ids[own]
    seen = ~np.isnan(learn)
    means = np.where(seen, learn, 0).sum(axis=0) / np.maximum(1, seen.sum(axis=0))
    out = [np.where(np.isnan(x), means, x) for _ in wants]
    asking, most = np.flatnonzero(np.isnan(x).any(axis=1)), max(k for k, _ in wants)
    for start in range(0, len(asking), STEP):
        rows = asking[start : start + STEP]
        d = _apart(ids[rows], x[rows], idl, learn)
        for j in np.flatnonzero(np.isnan(x[rows]).any(axis=0)):
            ask, have = np.flatnonzero(np.isnan(x[rows, j])), np.flatnonzero(seen[:, j])
            if not len(have):
                continue
            part = d[np.ix_(ask, have)]
            row, place = _smallest(part, idl[have], most)
            rank, apart, value = np.arange(len(row)) - np.searchsorted(row, row), part[row, place], learn[have[place], j]
            for (k, weights), done in zip(wants, out, strict=True):
                near = rank < k
                r, a = row[near], apart[near]
                w = np.ones(len(r))
                if weights == "distance":
                    zero = np.zeros(len(ask), bool)
                    zero[r[a == 0]] = True
                    w = np.where(zero[r], (a == 0).astype(float), 1 / np.where(a == 0, 1, a))
                total = np.bincount(r, w, len(ask))
                met = total > 0
                done[rows[ask[met]], j] = np.bincount(r, w * value[near], len(ask))[met] / total[met]
    return out
