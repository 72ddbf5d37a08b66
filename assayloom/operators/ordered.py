"""Order within groups of any size: running sums, ranks and quantiles without a group in one task.

A window over a group sorts all of it in one task. Here a group is cut into stretches, ranges of its order that every row finds for itself. The sums of
the stretches are few; added up they give where each begins, and only within a stretch rows are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a stretch that are aimed at, and stretches at most, a power of two.
ROWS, STRETCHES = 1 << 18, 1024
#: Cuts of a quantile's first look at a group, and the accuracy of Spark's sketch, whose rank is off by one in so many rows at most.
CUTS, ACCURACY = 512, 10_000


def _sketch(value: str, shares: list[float]) -> Column:
    """Spark's approximate percentiles. The shares are one text: as many literals would take longer to plan than to run."""
    return F.expr(f"percentile_approx(`{value}`, cast(split('{' '.join(map(repr, shares))}', ' ') as array<double>), {ACCURACY})")


def with_stretch(df: DataFrame, value: str, name: str = "__stretch") -> DataFrame:
    """``df`` with the stretch of each row by ``value``: ascending numbers, equal values in one, null before all.

    Cuts are quantiles of the whole table, so a group that holds most of it is cut as finely as that. They are one row, which is joined
    to all; tables of up to ROWS rows are one stretch."""
    most = STRETCHES
    cuts = df.agg(_sketch(value, [(i + 1) / most for i in range(most)]).alias("__cuts"), F.least(F.lit(most), F.ceil(F.count(value) / ROWS)).alias("__k"))
    v = F.col(value)
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(most.bit_length() - 1))))
    place = F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get("__cuts", at + step - 1) < v, step).otherwise(F.lit(0)))  # how many cuts are below
    stretch = F.when((F.col("__k") > 1) & v.isNotNull(), F.floor(place * F.col("__k") / most)).otherwise(F.when(v.isNull(), -1).otherwise(0))
    return df.crossJoin(F.broadcast(cuts)).withColumn(name, stretch.cast("long")).drop("__cuts", "__k")


def running(df: DataFrame, by: tuple[str, ...], stretch: Column, order: list[Column], sums: dict[str, Column], before: dict[str, Column] | None = None, place: Column | None = None) -> DataFrame:
    """``df`` with sums over each group's rows from its first to the row itself, in ``order``: for each of ``sums`` its name, and all_<name>
    over the whole group. ``before`` gives what the row before has, null for the first; it needs ``place``, one value that ascends with the
    order.

    ``stretch`` is a row's stretch; it ascends with the order, and rows that are equal in the order need one place each (or, if any
    order among them will do, none). Null keys are a group like any other."""
    before = before or {}
    key = F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate(by)), stretch.alias("s"))
    marked = df.withColumns({"__key": key} | {f"__v_{n}": v for n, v in sums.items()} | {f"__b_{n}": v for n, v in before.items()})
    last = [F.max_by(F.struct(f"__b_{n}"), place).alias(f"__e_{n}") for n in before]
    totals = marked.groupBy("__key").agg(*(F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums), *last)
    group = [F.col(f"__key.k{i}") for i in range(len(by))] or [F.lit(0)]
    earlier = Window.partitionBy(*group).orderBy("__key.s").rowsBetween(Window.unboundedPreceding, -1)
    ahead, whole = Window.partitionBy(*group).orderBy("__key.s"), Window.partitionBy(*group)
    starts = totals.select("__key", *(F.coalesce(F.sum(f"__t_{n}").over(earlier), F.lit(0)).alias(f"__o_{n}") for n in sums), *(F.sum(f"__t_{n}").over(whole).alias(f"all_{n}") for n in sums), *(F.lag(f"__e_{n}").over(ahead).alias(f"__l_{n}") for n in before))
    near = Window.partitionBy("__key").orderBy(*order)
    so_far = near.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = {n: F.col(f"__o_{n}") + F.sum(f"__v_{n}").over(so_far) for n in sums} | {n: F.coalesce(F.lag(F.struct(f"__b_{n}")).over(near), f"__l_{n}")[f"__b_{n}"] for n in before}
    met = marked.join(starts, "__key")
    return met.select(*(F.col(f"`{c}`") for c in df.columns), *(v.alias(n) for n, v in out.items()), *(f"all_{n}" for n in sums))


def quantiles(rows: DataFrame, by: tuple[str, ...], probabilities: list[float], value: str = "value", passes: int = 1) -> DataFrame:
    """(by, q array<double>): exact quantiles of the values that are not null, linear between two, one row a group with any.

    Spark's own exact percentile keeps all of a group's distinct values in one map. Here a sketch of fixed size brackets each quantile
    first, by CUTS cuts and more than its error on either side; what lies below is only counted, and only values inside are
    sorted. Each of the ``passes`` leaves one task about a CUTS-th part of a group's values, three or four of them. As many groups as rows of a
    table of features."""
    rows = rows.select(*by, F.col(value).alias("__v")).filter("__v is not null")
    n = rows.groupBy(*by).agg(F.count("*").alias("__n"))
    at = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probabilities))))
    pos = F.col("__p.p") * (F.col("__n") - 1)
    wanted = n.select(*by, "__n", at.alias("__p")).select(*by, F.col("__p.i").alias("__i"), pos.alias("__pos"), F.lit(None).cast("double").alias("__lo"), F.lit(None).cast("double").alias("__hi"))
    keys = [*by, "__i"]
    inside = F.coalesce(F.col("__v") >= F.col("__lo"), F.lit(True)) & F.coalesce(F.col("__v") <= F.col("__hi"), F.lit(True))
    for _ in range(passes):
        met = rows.join(F.broadcast(wanted), list(by)) if by else rows.crossJoin(F.broadcast(wanted))
        met = met.withColumn("__w", F.when(inside, F.col("__v")))
        seen = met.groupBy(*keys).agg(F.first("__pos").alias("__pos"), F.count_if(F.col("__v") < F.col("__lo")).alias("__below"), F.count("__w").alias("__m"), _sketch("__w", [i / CUTS for i in range(CUTS + 1)]).alias("__g"))
        first, last = F.floor("__pos") - F.col("__below"), F.ceil("__pos") - F.col("__below") + 1
        low = F.greatest(F.lit(0), F.floor(first * CUTS / F.col("__m")) - 1).cast("int")
        high = F.least(F.lit(CUTS), F.ceil(last * CUTS / F.col("__m")) + 1).cast("int")
        wanted = seen.select(*keys, "__pos", F.get("__g", low).cast("double").alias("__lo"), F.get("__g", high).cast("double").alias("__hi"))
    met = rows.join(F.broadcast(wanted), list(by)) if by else rows.crossJoin(F.broadcast(wanted))
    counted = met.filter(F.coalesce(F.col("__v") <= F.col("__hi"), F.lit(True))).groupBy(*keys, "__pos", F.when(inside, F.col("__v")).alias("__v")).agg(F.count("*").alias("__c"))
    so_far = Window.partitionBy(*keys).orderBy(F.asc_nulls_first("__v")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counted.withColumn("__c", F.sum("__c").over(so_far))
    ends = ranked.groupBy(*keys, "__pos").agg(F.min(F.when(F.col("__c") > F.floor("__pos"), F.col("__v"))).alias("__a"), F.min(F.when(F.col("__c") > F.ceil("__pos"), F.col("__v"))).alias("__b"))
    part = F.col("__pos") - F.floor("__pos")
    q = F.when(part == 0, F.col("__a").cast("double")).otherwise((1 - part) * F.col("__a") + part * F.col("__b"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("__i", q.alias("q")))), lambda s: s["q"])
    return ends.groupBy(*by).agg(listed.alias("q"))


def medians(rows: DataFrame, by: tuple[str, ...], value: str = "value") -> DataFrame:
    """(by, median double) of the values that are not null."""
    return quantiles(rows, by, [0.5], value).select(*by, F.col("q")[0].alias("median"))
