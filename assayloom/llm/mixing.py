"""Mixing sources to target weights by min-cost flow over membership patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayloom.llm.common import WORD, cut, spread_join

#: What a word's first, second and third use cost: convex, so repeats come last.
COSTS = (0, 1, 3)
WEIGHTS = (5, 2, 1)
SLICES = 4096


def count_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shared_targets(sizes: dict, weights: dict, most: float = len(COSTS)) -> dict:
    """The whole of all sizes by weight, no share above ``most`` times its own size; what is above is shared again by weight."""
    target, free, left = {}, list(sizes), float(sum(sizes.values()))
    while free:
        weight = sum(weights[s] for s in free)
        over = [s for s in free if left * weights[s] / weight > most * sizes[s]]
        if not over:
            return target | {s: left * weights[s] / weight for s in free}
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
        free = [s for s in free if s not in over]
    return target


class _Flow:
    """Largest flows on a small graph of whole capacities, by blocking flows in layers."""

    def __init__(self, n: int):
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.room: list[int] = []

    def edge(self, a: int, b: int, room: int) -> int:
        for x, y, r in ((a, b, room), (b, a, 0)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
        return len(self.to) - 2

    def _layers(self, s: int) -> list[int]:
        layer, queue = [-1] * len(self.out), [s]
        layer[s] = 0
        for a in queue:
            for e in self.out[a]:
                if self.room[e] and layer[self.to[e]] < 0:
                    layer[self.to[e]] = layer[a] + 1
                    queue.append(self.to[e])
        return layer

    def run(self, s: int, t: int) -> None:
        """Add to the flow until no path is left."""
        while (layer := self._layers(s))[t] >= 0:
            turn, path, a = [0] * len(self.out), [], s
            while True:
                if a == t:
                    step = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= step
                        self.room[e ^ 1] += step
                    full = next(i for i, e in enumerate(path) if not self.room[e])
                    a = self.to[path[full] ^ 1]
                    del path[full:]
                    continue
                while turn[a] < len(self.out[a]):
                    e = self.out[a][turn[a]]
                    if self.room[e] and layer[self.to[e]] == layer[a] + 1:
                        break
                    turn[a] += 1
                if turn[a] < len(self.out[a]):
                    path.append(self.out[a][turn[a]])
                    a = self.to[path[-1]]
                elif path:
                    a = self.to[path.pop() ^ 1]
                    turn[a] += 1
                else:
                    break


def route(patterns: dict[tuple, int], targets: dict) -> dict[tuple, dict]:
    """Words that each membership pattern (a tuple of sources) sends to each of its sources: as much of the targets as can be met,
    at the least cost of repeats; a pattern's words can be used as often as there are costs.

    Only the edges into patterns cost, and what one use of a pattern's words costs rises. So a path of least cost never gives
    such an edge's flow back, and the min-cost flow is the largest flow with the cheapest uses, then with the next ones, and so on.
    """
    name = lambda s: (s is None, s or "")
    sources, keys = sorted(targets, key=name), sorted(patterns, key=lambda p: [name(s) for s in p])
    flow = _Flow(2 + len(keys) + len(sources))
    place = {s: 2 + len(keys) + i for i, s in enumerate(sources)}
    total = sum(patterns.values()) * len(COSTS)
    for s in sources:
        flow.edge(place[s], 1, round(targets[s]))
    sent = {(p, s): flow.edge(2 + i, place[s], total) for i, p in enumerate(keys) for s in p}
    for _ in COSTS:
        for i, p in enumerate(keys):
            flow.edge(0, 2 + i, patterns[p])
        flow.run(0, 1)
    return {p: {s: flow.room[sent[p, s] ^ 1] for s in p} for p in keys}


def _marks(docs: DataFrame, member: str, seed: int) -> list[Column]:
    """doc_id, pattern (the sorted sources of a row) and h, a seeded hash of id, text and sources."""
    source = F.col(f"`{member}`")
    if dict(docs.dtypes)[member].startswith("array"):
        groups = F.sort_array(F.array_distinct(F.coalesce(source.cast("array<string>"), F.array())))
        groups = F.when(F.size(groups) > 0, groups).otherwise(F.array(F.lit(None).cast("string")))
    else:
        groups = F.array(source.cast("string"))
    doc_id = F.col("doc_id").cast("long")
    return [doc_id.alias("doc_id"), groups.alias("pattern"), F.xxhash64(F.lit(seed), doc_id, F.col("text").cast("string"), groups).alias("h")]


def mix(docs: DataFrame, member: str = "source", weights: tuple[float, ...] = WEIGHTS, seed: int = 42, most_patterns: int = 50_000) -> DataFrame:
    """(doc_id long, size long, pattern array<string>, source_size long, target double, taken long), one row per row of ``docs``.

    ``member`` is the column with a document's source, or an array column with all its sources (an empty or null one is the
    source null). Sizes are whole texts' words. Sources in code point order, null last, weigh ``weights`` in turn; see
    shared_targets. Documents are aggregated by membership pattern; the min-cost flow over those (an error beyond
    ``most_patterns``, so the driver's share is bounded) says how often each pattern is used. A pattern used q times its size
    gives every document floor(q) times, and once more to documents chosen by a seeded hash until the rest is met, each whole.
    Documents above a sixty-fourth of that rest toss a coin first and the others fill up, so the end lies near the quota.
    A document belonging to several sources reports the size and target of the first. No document exceeds three times its
    size; empty ones take 0. Rows repeated whole are taken alike; reruns agree, however the rows are spread.
    """
    rows = cut(docs.select(*_marks(docs, member, seed), count_words("`text`").alias("size")))

    by = {tuple(r[0]): r[1] for r in rows.groupBy("pattern").agg(F.sum("size")).limit(most_patterns + 1).collect()}
    if len(by) > most_patterns:
        raise ValueError(f"more than {most_patterns} membership patterns")
    sizes: dict = {}
    for p, n in by.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-8")))
    whole = sum(by.values())
    scale = whole / max(1, sum(sizes.values()))  # overlaps count once in what is shared
    shares = shared_targets(sizes, {s: weights[i % len(weights)] for i, s in enumerate(order)}) if scale == 1 else {s: t * scale for s, t in shared_targets(sizes, {s: weights[i % len(weights)] for i, s in enumerate(order)}).items()}
    routed = route(by, shares)
    plan = []
    for p, n in by.items():
        use = sum(routed[p].values())
        plan.append((list(p), n, use // n if n else 0, use % n if n else 0, sizes[p[0]], shares[p[0]]))
    spark = docs.sparkSession
    table = spark.createDataFrame(plan, "pattern array<string>, words long, times long, rest long, source_size long, target double")
    # Patterns hold nulls, so they meet by a text of their own.
    key = F.to_json(F.struct(F.transform("pattern", lambda s: F.struct(s.alias("s"))).alias("p")))
    joined = rows.withColumn("key", key).join(F.broadcast(table.withColumn("key", key).drop("pattern")), "key")  # most_patterns rows

    coin = F.pmod(F.xxhash64(F.lit(seed + 1), "h"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    large = F.col("size") * 64 > F.col("rest")
    turn = F.when(~large, 1).when(coin * F.col("words") < F.col("rest"), 0).otherwise(2)
    some = joined.withColumn("slice", turn * SLICES + F.pmod(F.shiftright("h", 20), F.lit(SLICES)))
    sums = some.filter("rest > 0 and size > 0").groupBy("key", "slice").agg(F.sum("size").alias("mass"), F.first("rest").alias("rest"))
    run = Window.partitionBy("key").orderBy("slice")  # three times SLICES rows a pattern
    sums = sums.withColumn("upto", F.sum("mass").over(run))
    edge = cut(sums.filter("upto >= rest and upto - mass < rest").select("key", F.col("slice").alias("edge"), (F.col("upto") - F.col("mass")).alias("below")))
    placed = some.join(F.broadcast(edge), "key", "left")  # a row a pattern
    within = placed.filter("slice = edge and size > 0")
    inside = Window.partitionBy("key").orderBy("h", "doc_id", "size").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.col("below") + F.sum("size").over(inside)
    chosen = within.withColumn("more", (upto - F.floor(F.col("size") / 2) <= F.col("rest")).cast("long"))
    others = placed.filter("edge is null or slice <> edge or size = 0").withColumn("more", F.when((F.col("size") > 0) & (F.col("slice") < F.col("edge")), 1).otherwise(0).cast("long"))
    return chosen.unionByName(others).select("doc_id", "size", "pattern", "source_size", "target", F.when(F.col("size") > 0, F.col("size") * (F.col("times") + F.coalesce("more", F.lit(0)))).otherwise(F.lit(0)).cast("long").alias("taken"), "h")


def resample(docs: DataFrame, member: str = "source", seed: int = 42, **how) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, not at all included; all columns stay. Rows without words go.

    Rows equal in id, text and source are taken alike; an empty table gives no rows.
    """
    taken = mix(docs, member, seed=seed, **how).filter("taken > 0")
    taken = cut(taken.groupBy(F.coalesce("doc_id", F.lit(0)).alias("i"), "h").agg(F.first(F.expr("taken div size")).alias("times"), F.count("*").alias("copies")))
    doc_id, _, h = _marks(docs, member, seed)
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(doc_id, F.lit(0)).alias("i"), h.alias("h"))
    met = spread_join(keyed, taken, ["i", "h"])
    return met.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("n")).select("row.*")
