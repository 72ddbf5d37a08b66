"""Small tree learners in NumPy, for tasks that fit many models on a few hundred rows each.

Split rule: a row goes left where x <= threshold; a missing value goes to the side that was better in the fit. Trees are arrays, node
0 the root; a leaf has feature -1.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from math import factorial

import numpy as np


@dataclass
class Tree:
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    gain: np.ndarray
    missing_left: np.ndarray | None = None

    def goes_left(self, node: np.ndarray | int, x: np.ndarray) -> np.ndarray:
        """Whether values go left at their nodes."""
        low = x <= self.threshold[node]
        return low if self.missing_left is None else np.where(np.isnan(x), self.missing_left[node], low)

    def leaf(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while True:
            inner = np.flatnonzero(self.feature[at] >= 0)
            if not len(inner):
                return at
            node = at[inner]
            low = self.goes_left(node, x[inner, self.feature[node]])
            at[inner] = np.where(low, self.left[node], self.right[node])

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.value[self.leaf(x)]

    def expected(self, x: np.ndarray, known: frozenset[int]) -> float:
        """The value of one row whose other features are unknown, by the share of rows either way."""

        def walk(n: int) -> float:
            f = self.feature[n]
            if f < 0:
                return float(self.value[n])
            if f in known:
                return walk(self.left[n] if self.goes_left(n, x[f]) else self.right[n])
            a, b = self.left[n], self.right[n]
            return (self.cover[a] * walk(a) + self.cover[b] * walk(b)) / (self.cover[a] + self.cover[b])

        return walk(0)

    def ejected(self, x: np.ndarray, known: frozenset[int]) -> float:
        """The value of the node at which the row leaves the tree: the first split on a feature that is not known, or a leaf."""
        n = 0
        while (f := self.feature[n]) >= 0 and f in known:
            n = self.left[n] if self.goes_left(n, x[f]) else self.right[n]
        return float(self.value[n])

    def shapley(self, x: np.ndarray, game: str = "expected") -> np.ndarray:
        """Exact Shapley values of the rows over the tree's features, in a time that grows with the leaves and the squares of their
        depths, not with the sets of features.

        "expected" is a sum over leaves of products, one factor a feature on the way: whether the row may pass if the feature is known,
        else the share of rows that do. "ejected" is a sum over the nodes that a row passes of what each adds, due once all features before it
        are known, to equal parts."""
        out = np.zeros(x.shape)
        todo: list[tuple[int, dict[int, tuple[np.ndarray, float]], float]] = [(0, {}, 0.0)]
        while todo:
            n, path, before = todo.pop()
            f, value, own = int(self.feature[n]), float(self.value[n]), list(path)
            if game == "ejected" and own:
                passes = np.logical_and.reduce([known for known, _ in path.values()])
                out[:, own] += (passes * (value - before) / len(own))[:, None]
            if f < 0:
                if game == "expected" and own:
                    out[:, own] += value * _product_shares(np.array([known for known, _ in path.values()], float), np.array([share for _, share in path.values()])).T
                continue
            low, (known, share) = self.goes_left(n, x[:, f]), path.get(f, (True, 1.0))
            total = self.cover[self.left[n]] + self.cover[self.right[n]]
            todo += [(int(child), {**path, f: (known & side, share * float(self.cover[child]) / float(total))}, value) for child, side in ((self.left[n], low), (self.right[n], ~low))]
        return out


def _product_shares(known: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Shapley values, a row a factor, of the product of factors that are ``known`` (a row a factor) if theirs is in the set, else ``share``:
    without a factor the others' products, by how many of them are known, each number of known ones weighed by its orders."""
    m = len(share)
    others = np.zeros((m, m, known.shape[1]))  # factor left out, number of known ones, row
    others[:, 0] = 1
    for g in range(m):
        rest = np.arange(m) != g
        grown = others[rest] * share[g]
        grown[:, 1:] += others[rest][:, :-1] * known[g]
        others[rest] = grown
    orders = np.array([factorial(k) * factorial(m - 1 - k) / factorial(m) for k in range(m)])
    return (known - share[:, None]) * np.einsum("fkr,k->fr", others, orders)


@dataclass(frozen=True)
class Shape:
    """What limits and scores a tree. ``child`` is the least sum of hessians of a side, ``min_leaf`` its least rows, ``min_share`` its least
    share of all hessians; a node with fewer rows than ``min_split`` is a leaf, and there are ``leaves`` leaves at most. ``lam``
    and ``alpha`` are the L2 and L1 penalties of leaf values, ``gamma`` what half of a split's gain must exceed. ``criterion``
    "square" scores by second-order gain (for 0/1 targets the Gini split), "entropy" by the entropy of those targets."""

    depth: int = 6
    child: float = 1.0
    lam: float = 0.0
    alpha: float = 0.0
    gamma: float = 0.0
    min_split: int = 2
    min_leaf: int = 1
    min_share: float = 0.0
    leaves: int | None = None
    criterion: str = "square"

    def pull(self, g: np.ndarray) -> np.ndarray:
        return np.sign(g) * np.maximum(np.abs(g) - self.alpha, 0) if self.alpha else g

    def score(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        with np.errstate(invalid="ignore", divide="ignore"):
            if self.criterion == "entropy":
                p = np.clip(-g / h, 1e-12, 1 - 1e-12)
                return h * (p * np.log(p) + (1 - p) * np.log(1 - p))
            return self.pull(g) ** 2 / (h + self.lam)

    def gains(self, a: np.ndarray, b: np.ndarray, g: float, h: float, spare: list[np.ndarray]) -> np.ndarray:
        """The scores of sides with sums ``a`` and ``b`` and of the sides with the rest of ``g`` and ``h``, added up; made in the ``spare`` arrays."""
        if self.criterion == "entropy" or self.alpha:
            return self.score(a, b) + self.score(g - a, h - b)
        out, other, below = (s[: a.size].reshape(a.shape) for s in spare)
        with np.errstate(invalid="ignore", divide="ignore"):
            np.divide(np.square(a, out=out), np.add(b, self.lam, out=below[: len(b)]) if self.lam else b, out=out)
            np.square(np.subtract(g, a, out=other), out=other)
            rest = np.subtract(h, b, out=below[: len(b)])
            np.divide(other, np.add(rest, self.lam, out=rest) if self.lam else rest, out=other)
        return np.add(out, other, out=out)


#: Places of features' orders that are looked at together, in buffers that stay in a core's cache.
CELLS = 1 << 15


def ranked(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each column (a row each) the place of each value among its distinct ones, missing values after all, and the rows in that order,
    equal ones as they come. A fit takes them once (or is given them); its nodes pick their rows out of the order, so only small nodes sort."""
    codes, orders = np.zeros(x.shape[::-1], np.uint32), np.zeros(x.shape[::-1], np.int32)
    for j, column in enumerate(x.T):
        column = np.ascontiguousarray(column)
        orders[j] = order = column.argsort(kind="stable")
        v = column[order]
        codes[j, order[1:]] = np.cumsum((v[1:] > v[:-1]) | (np.isnan(v[1:]) & ~np.isnan(v[:-1])))
    return codes.astype(np.uint16) if codes.max(initial=0) < 1 << 16 else codes, orders


def _by_code(code: np.ndarray) -> np.ndarray:
    """The stable order of the codes. Sorts of 16 bits take a time that grows with the rows."""
    if code.dtype == np.uint16:
        return code.argsort(kind="stable")
    order = code.astype(np.uint16).argsort(kind="stable")
    return order[(code >> 16).astype(np.uint16)[order].argsort(kind="stable")]


def _among(orders: np.ndarray, use: np.ndarray, inside: np.ndarray, size: int) -> np.ndarray:
    """The orders of the features ``use`` without the rows that are not ``inside``; ``size`` are."""
    out, step = np.empty((len(use), size), np.int32), max(1, CELLS // max(1, orders.shape[1]))
    for s in range(0, len(use), step):
        o = orders[use[s : s + step]]
        out[s : s + step] = o.ravel().take(np.flatnonzero(inside.take(o))).reshape(-1, size)  # a mask that looks random is slow to index by
    return out


def _best_split(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, many: np.ndarray | None, rows: np.ndarray, use: np.ndarray, total: float, shape: Shape, codes: np.ndarray, orders: np.ndarray, gaps: bool, plain: bool, distinct: np.ndarray, spare: list[np.ndarray]) -> tuple | None:
    """(gain, feature, threshold, missing left) of the rows' best split, a few features at a time and both sides for the missing. Of equal gains the
    split after the fewest rows counts, then the first feature. ``orders`` has the rows by each feature of ``use``; a row stands for ``many``
    (default: one), whose gradients are summed in ``grad``. ``plain``: all hessians are 1;
    ``distinct``: of each feature, whether no values are equal. ``spare`` are arrays to work in."""
    gt, ht, size = grad[rows].sum(), hess[rows].sum(), len(rows)
    n = size if many is None else float(many[rows].sum())
    whole, least = shape.score(gt, ht), max(shape.child, shape.min_share * total)
    gaps = gaps and bool(np.isnan(x[np.ix_(rows, use)]).any())
    best: list[tuple | None] = [None, None]
    step, flat = 1 if gaps else max(1, CELLS // max(1, size)), codes.ravel()

    def taken(of: np.ndarray, order: np.ndarray, place: int) -> np.ndarray:
        out = spare[place][: order.size].reshape(order.shape)
        return np.cumsum(of.take(order, out=out, mode="clip"), axis=1, out=out)

    for s in range(0, len(use), step):
        part, order = use[s : s + step], orders[s : s + step]
        same, lost = None, 0
        if gaps or not distinct[part].all():
            code = codes[part[0]].take(order) if len(part) == 1 else flat.take(order + (part * codes.shape[1])[:, None])
            lost = int(np.isnan(x[order[0, np.searchsorted(code[0], code[0, -1]) :], part[0]]).sum()) if gaps else 0
            same = code[:, 1 : size - lost] == code[:, : max(0, size - lost - 1)]
        stay = size - lost
        if stay < 2:
            continue
        order = order[:, :stay]
        gl = taken(grad, order, 0)
        nl = np.arange(1.0, stay + 1)[None] if many is None else taken(many, order, 1)
        hl = nl if plain else taken(hess, order, 2)
        for left in (False, True)[: 1 + gaps]:
            a, b = (gl[:, :-1] + (gt - gl[:, -1:]), hl[:, :-1] + (ht - hl[:, -1:])) if left else (gl[:, :-1], hl[:, :-1])
            gain = shape.gains(a, b, gt, ht, spare[3:])
            gain -= whole
            if same is not None:
                np.copyto(gain, -np.inf, where=same)
            if b[:, 0].min() < least or ht - b[:, -1].max() < least:  # sides only grow along the order
                np.copyto(gain, -np.inf, where=(b < least) | (ht - b < least))
            if shape.min_leaf > 1:
                beside = nl[:, :-1] + (n - nl[:, -1:] if left else 0)
                np.copyto(gain, -np.inf, where=(beside < shape.min_leaf) | (n - beside < shape.min_leaf))
            at = gain.argmax(axis=1)
            top = gain[np.arange(len(at)), at]
            if np.isnan(top).any() or (top == np.inf).any():
                gain[~np.isfinite(gain)] = -np.inf
                at = gain.argmax(axis=1)
                top = gain[np.arange(len(at)), at]
            for k in np.flatnonzero(top >= max(top.max(), best[left][0] if best[left] else -np.inf)):
                found = (float(top[k]), -float(nl[k if len(nl) > 1 else 0, at[k]]), -(s + int(k)), order[k, at[k]], order[k, at[k] + 1])
                if np.isfinite(found[0]) and (best[left] is None or found[:3] > best[left][:3]):
                    best[left] = found
    out = None
    for left, found in zip((False, True), best, strict=True):
        if found and found[0] > 1e-12 and found[0] / 2 > shape.gamma and (out is None or found[0] > out[0]):
            gain, _, place, low, high = found
            j = int(use[-place])
            out = (gain, j, float((float(x[low, j]) + float(x[high, j])) / 2), left)
    return out


def grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, shape: Shape, columns: np.ndarray | None = None, rng: np.random.Generator | None = None, mtry: int | None = None, known: tuple[np.ndarray, np.ndarray] | None = None, sample: np.ndarray | None = None, gaps: bool | None = None) -> Tree:
    """A tree that splits where most is gained next; leaf values are -sum(grad) / (sum(hess) + lam), grad drawn towards 0 by alpha. It learns from the
    rows ``sample`` (default: all), some of them perhaps several times; ``known`` is what ``ranked`` says of ``x``, ``gaps`` whether values are missing."""
    columns = np.arange(x.shape[1]) if columns is None else columns
    codes, orders = ranked(x) if known is None else known
    gaps = bool(np.isnan(x).any()) if gaps is None else gaps
    plain, many = bool((hess == 1).all()), None
    if sample is not None:
        times = np.bincount(sample, minlength=len(x))
        sample = np.flatnonzero(times)
        if times.max(initial=0) > 1:
            many = times.astype(float)
            grad, hess = grad * many, hess * many
    else:
        sample = np.arange(len(x))
    total = float(hess[sample].sum())
    distinct = codes[np.arange(len(codes)), orders[:, -1]] == len(x) - 1 if len(x) else np.zeros(len(codes), bool)
    spare = [np.empty(max(len(sample), CELLS)) for _ in range(6)]
    nodes: list[list] = []
    todo: list[tuple] = []

    def ordered(rows: np.ndarray, use: np.ndarray, held: np.ndarray, of: np.ndarray) -> np.ndarray:
        """The rows by each feature of ``use``, out of the orders ``of`` of a node above that are held."""
        if len(rows) == held.shape[1]:
            return held if len(of) == len(held) and (of == np.arange(len(of))).all() else held[of]
        if len(rows) * 12 < held.shape[1]:
            if codes.dtype == np.uint16:
                return rows.take(codes[np.ix_(use, rows)].argsort(axis=1, kind="stable"))
            return np.stack([rows[_by_code(codes[j][rows])] for j in use])
        inside = np.zeros(len(x), bool)
        inside[rows] = True
        return _among(held, of, inside, len(rows))

    def add(rows: np.ndarray, level: int, held: np.ndarray) -> int:
        n, g, h = len(nodes), grad[rows].sum(), hess[rows].sum()
        nodes.append([-1, 0.0, -1, -1, -float(shape.pull(g)) / (h + shape.lam) if h + shape.lam > 0 else 0.0, h, 0.0, False])
        if level < shape.depth and (len(rows) if many is None else many[rows].sum()) >= max(2, shape.min_split):
            use = columns if mtry is None else rng.choice(columns, min(mtry, len(columns)), replace=False)
            if len(use) and len(rows):
                own = ordered(rows, use, held, use if mtry is not None or held is orders else np.arange(len(use)))
                if split := _best_split(x, grad, hess, many, rows, use, total, shape, codes, own, gaps, plain, distinct, spare):
                    heapq.heappush(todo, (-split[0], n, level, rows, split, own if mtry is None and level + 1 < shape.depth else orders))
        return n

    add(sample, 0, orders)
    leaves = 1
    while todo and (shape.leaves is None or leaves < shape.leaves):
        _, n, level, rows, (gain, f, t, missing), held = heapq.heappop(todo)
        v = x[rows, f]
        low = np.where(np.isnan(v), missing, v <= np.float64(t))
        if low.all() or not low.any():
            continue
        a, b = add(rows[low], level + 1, held), add(rows[~low], level + 1, held)
        nodes[n][:4], nodes[n][6:] = [f, t, a, b], [gain, missing]
        leaves += 1
    f, t, a, b, v, c, g, m = (np.array(col) for col in zip(*nodes, strict=True))
    return Tree(f.astype(np.int64), t.astype(float), a.astype(np.int64), b.astype(np.int64), v.astype(float), c.astype(float), g.astype(float), m.astype(bool))


@dataclass
class Forest:
    trees: list[Tree]
    scale: float = 1.0
    base: float = 0.0
    logit: bool = False

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.base + self.scale * sum((t.predict(x) for t in self.trees), np.zeros(len(x)))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.of_margin(self.margin(x))

    def of_margin(self, m: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(m, -40, 40))) if self.logit else m

    def importance(self, n_features: int) -> np.ndarray:
        """The gain of each feature's splits, adding up to 1."""
        out = np.zeros(n_features)
        for t in self.trees:
            inner = t.feature >= 0
            np.add.at(out, t.feature[inner], t.gain[inner])
        return out / out.sum() if out.sum() else out

    def shapley(self, x: np.ndarray, game: str = "expected") -> np.ndarray:
        """Shapley values of the margin, a row a row of ``x``."""
        return self.scale * sum((t.shapley(x, game) for t in self.trees), np.zeros(x.shape))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 200, rate: float = 0.05, depth: int = 2, lam: float = 0.0, alpha: float = 0.0, gamma: float = 0.0, child_weight: float = 1.0, subsample: float = 1.0, columns: float = 1.0, balance: bool = True, logistic: bool = True, seed: int = 0, known: tuple[np.ndarray, np.ndarray] | None = None, begun: list[Tree] | None = None) -> Forest:
    """Gradient-boosted trees on the logistic loss, positives weighing sqrt(n0 / n1), or on the squared one. Each tree sees the shares
    ``subsample`` of the rows and ``columns`` of the features, drawn anew; missing values take the better side. ``known`` is what ``ranked`` says of ``x``; the first trees may be ``begun`` already."""
    rng, n = np.random.default_rng(seed), len(y)
    w = np.where(y == 1, np.sqrt(max(1, (y == 0).sum()) / max(1, (y == 1).sum())) if balance else 1.0, 1.0) if logistic else np.ones(n)
    base = 0.0 if logistic else float(y.mean())
    margin, out, shape, gaps = np.full(n, base), [], Shape(depth, child_weight, lam + 1e-9, alpha, gamma), bool(np.isnan(x).any())
    known = ranked(x) if known is None else known
    for i in range(trees):
        if logistic:
            p = 1 / (1 + np.exp(-np.clip(margin, -40, 40)))
            grad, hess = w * (p - y), np.maximum(w * p * (1 - p), 1e-6)
        else:
            grad, hess = margin - y, np.ones(n)
        rows = np.sort(rng.choice(n, max(1, round(subsample * n)), replace=False)) if subsample < 1 else None
        own = np.sort(rng.choice(x.shape[1], max(1, int(columns * x.shape[1])), replace=False)) if columns < 1 else None
        out.append(begun[i] if begun and i < len(begun) else grow(x, grad, hess, shape, own, known=known, sample=rows, gaps=gaps))
        margin = margin + rate * out[-1].predict(x)
    return Forest(out, rate, base, logistic)


def grow_forest(x: np.ndarray, y: np.ndarray, trees: int = 200, depth: int = 3, balanced: bool = False, seed: int = 0, features: str = "sqrt", criterion: str = "gini", min_split: int = 2, min_leaf: int = 1, min_share: float = 0.0, leaves: int | None = None, known: tuple[np.ndarray, np.ndarray] | None = None) -> Forest:
    """A random forest on the squared loss (for 0/1 targets: the Gini split) or, for those, the entropy ("entropy", "log_loss");
    ``balanced`` gives each tree as many rows of either class, each once at most, else it draws with replacement."""
    rng, n, m = np.random.default_rng(seed), len(y), x.shape[1]
    mtry = {"sqrt": max(1, int(np.sqrt(m))), "log2": max(1, int(np.log2(max(1, m)))), "all": None}[features]
    shape = Shape(depth, min_split=min_split, min_leaf=min_leaf, min_share=min_share, leaves=leaves, criterion={"gini": "square", "entropy": "entropy", "log_loss": "entropy"}[criterion])
    out, grad, hess, gaps = [], -y.astype(float), np.ones(n), bool(np.isnan(x).any())
    known = ranked(x) if known is None else known
    for _ in range(trees):
        if balanced:
            least = max(1, int(min((y == 1).sum(), (y == 0).sum())))
            rows = np.concatenate([rng.choice(own, min(least, len(own)), replace=False) for c in (0, 1) if len(own := np.flatnonzero(y == c))])
        else:
            rows = rng.integers(0, n, n)
        out.append(grow(x, grad, hess, shape, rng=rng, mtry=mtry, known=known, sample=rows, gaps=gaps))
    return Forest(out, 1 / max(1, trees))


def nodes_of(forest: Forest) -> list[tuple]:
    """A row a node: tree, node, feature (-1 for a leaf), threshold, left, right, value, cover, gain, missing_left; and on each row the
    forest's scale, base and whether it predicts by the logistic function. What a model is stored as."""
    out = []
    for i, t in enumerate(forest.trees):
        missing = np.zeros(len(t.feature), bool) if t.missing_left is None else t.missing_left
        columns = (t.feature, t.threshold, t.left, t.right, t.value, t.cover, t.gain, missing)
        out += [(i, n, *(v.item() for v in row), forest.scale, forest.base, forest.logit) for n, row in enumerate(zip(*columns, strict=True))]
    return out


NODES = "tree int, node int, feature int, threshold double, left int, right int, value double, cover double, gain double, missing_left boolean, scale double, base double, logit boolean"


def from_nodes(rows: list[tuple]) -> Forest:
    """The forest that nodes_of wrote down, from its rows in any order."""
    trees: dict[int, list[tuple]] = {}
    for r in sorted(tuple(r) for r in rows):
        trees.setdefault(r[0], []).append(r[2:10])
    made = []
    for own in trees.values():
        f, t, a, b, v, c, g, m = (np.array(x) for x in zip(*own, strict=True))
        made.append(Tree(f.astype(np.int64), t.astype(float), a.astype(np.int64), b.astype(np.int64), v.astype(float), c.astype(float), g.astype(float), m.astype(bool)))
    scale, base, logit = next((r[10:13] for r in rows), (1.0, 0.0, False))
    return Forest(made, scale, base, logit)


#: The settings of each learner where nothing is searched.
LEARNERS = {
    "xgboost": lambda x, y, seed=0, **p: boost(x, y, **{"trees": 200, "rate": 0.05, "depth": 2, "seed": seed, **p}),
    "balanced_random_forest": lambda x, y, seed=0, **p: grow_forest(x, y, **{"trees": 500, "depth": 10, "balanced": True, "seed": seed, **p}),
    "random_forest": lambda x, y, seed=0, **p: grow_forest(x, y, **{"trees": 200, "depth": 3, "seed": seed, **p}),
}


def learner(name: str):
    """A function (x, y, **parameters) that fits and gives a Forest; an unknown name is not implemented."""
    if name not in LEARNERS:
        raise NotImplementedError(name)
    return LEARNERS[name]
