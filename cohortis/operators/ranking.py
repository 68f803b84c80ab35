"""Exact row numbers, rank cut points and running totals without a single-task window.

A plain ``row_number() over (partition by label order by ...)`` sends every row
of a label to one task. Here the order is first cut into many buckets; bucket
sizes are a small aggregate, and only rows of one bucket meet in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cohortis.functions.keyed import HASH_BITS, keyed_hash
from cohortis.session import join_on, small_side

# 2**12 buckets per group: a label with 10**11 rows leaves about 2.4e7 rows per task.
BUCKET_BITS = 12
# Largest group of pre-aggregated cells that one window task sorts.
CELLS_PER_TASK = 2_000_000
QUANTILE_BUCKETS = 512
# Cut points for rows ordered by a numeric key, and the rows wanted between two of them.
KEY_QUANTILES = 1_024
ROWS_PER_BUCKET = 1_000_000


def _offsets(bucketed: DataFrame, by: list[str]) -> DataFrame:
    sizes = bucketed.groupBy(*by, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*by).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    return sizes.select(*by, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))


def _quantile_buckets(df: DataFrame, key: str) -> DataFrame:
    """Add ``__b``, the place of ``key`` among approximate quantiles (a binary search per row).

    At most KEY_QUANTILES numbers come to the driver; a small frame keeps only some of them.
    """
    steps = ", ".join(f"{i / KEY_QUANTILES!r}D" for i in range(1, KEY_QUANTILES))
    quantiles = F.expr(f"percentile_approx(cast(`{key}` as double), array({steps}), {5 * KEY_QUANTILES})")
    n, found = df.agg(F.count(F.lit(1)), quantiles).first()
    wanted = max(8, min(KEY_QUANTILES, n // ROWS_PER_BUCKET))
    bounds = sorted(set((found or [])[:: max(1, KEY_QUANTILES // wanted)]))
    if not bounds:
        return df.withColumn("__b", F.lit(0))
    cut = Bucketizer(splits=[float("-inf"), *bounds, float("inf")], inputCol="__kd", outputCol="__b", handleInvalid="keep")
    return cut.transform(df.withColumn("__kd", F.col(key).cast("double"))).drop("__kd")


def row_numbers(
    df: DataFrame,
    by: list[str],
    key: str,
    seed: int | None = None,
    purpose: str = "order",
    out: str = "row_no",
    bits: int = BUCKET_BITS,
) -> DataFrame:
    """Dense 0-based row number inside each ``by`` group.

    With a ``seed`` the order is a keyed shuffle (hash, then key). Without one
    it is the order of ``key``, which must be a unique number; buckets are then
    approximate quantiles of the key, which affects balance and never the result.
    """
    groups = by or ["__all"]
    if not by:
        df = df.withColumn("__all", F.lit(0))
    if seed is None:
        bucketed = _quantile_buckets(df, key)
        order = [F.col(key)]
    else:
        hashed = df.withColumn("__h", keyed_hash(seed, purpose, key))
        bucketed = hashed.withColumn("__b", F.shiftright("__h", HASH_BITS - bits))
        order = [F.col("__h"), F.col(key)]
    placed = join_on(bucketed, _offsets(bucketed, groups), [*groups, "__b"])
    inside = W.partitionBy(*groups, "__b").orderBy(*order)
    numbered = placed.withColumn(out, F.row_number().over(inside) - 1 + F.col("__off"))
    return numbered.drop("__h", "__b", "__off", "__all")


def assign_by_rank(
    df: DataFrame,
    by: str,
    key: str,
    seed: int,
    purpose: str,
    targets: Callable[[Column], list[Column]],
    out: str,
    bits: int = BUCKET_BITS,
) -> DataFrame:
    """Cut each ``by`` group, in keyed-shuffle order, at exact ranks ``targets(n)``.

    ``out`` is the number of targets below the row's 1-based rank: 0 for the
    first slice, 1 for the next and so on. The wide rows are not shuffled: a histogram of
    hash buckets finds the bucket of each cut, only the rows of those buckets
    are ranked, and the cut keys (a few per group) then go to every row.
    """
    h = keyed_hash(seed, purpose, key)
    narrow = df.select(F.col(f"`{by}`").alias("__g"), h.alias("__h"), F.col(key).alias("__k"))
    narrow = narrow.withColumn("__b", F.shiftright("__h", HASH_BITS - bits))
    sizes = narrow.groupBy("__g", "__b").agg(F.count(F.lit(1)).alias("__n"))
    grouped = W.partitionBy("__g")
    running = grouped.orderBy("__b").rowsBetween(W.unboundedPreceding, 0)
    histogram = sizes.select(
        "__g", "__b", "__n", F.sum("__n").over(running).alias("__run"), F.sum("__n").over(grouped).alias("__total")
    )
    wanted = targets(F.col("__total"))
    cuts = histogram.select("*", F.explode(F.array(*[t.cast("bigint") for t in wanted])).alias("__t"))
    cuts = cuts.where((F.col("__t") <= F.col("__run")) & (F.col("__t") > F.col("__run") - F.col("__n")))
    cuts = cuts.select("__g", "__b", "__t", (F.col("__t") - F.col("__run") + F.col("__n")).alias("__left")).distinct()
    cuts = small_side(cuts)
    near = join_on(narrow, cuts, ["__g", "__b"])
    ranked = near.withColumn("__rn", F.row_number().over(W.partitionBy("__g", "__t").orderBy("__h", "__k")))
    exact = ranked.where(F.col("__rn") == F.col("__left"))
    keys = small_side(exact.groupBy("__g").agg(F.collect_list(F.struct("__t", "__h", "__k")).alias("__cuts")))
    # Targets are distinct ranks of one group; a target of 0 has no row and lies below all.
    here = df.withColumn("__h", h).withColumn("__g", F.col(f"`{by}`"))
    joined = join_on(here, keys, ["__g"], "left")
    at_or_after = F.coalesce(
        F.size(F.filter("__cuts", lambda c: (c["__h"] > F.col("__h")) | (
            (c["__h"] == F.col("__h")) & (c["__k"] >= F.col(key))))),
        F.lit(0),
    )
    return joined.withColumn(out, (F.lit(len(wanted)) - at_or_after).cast("int")).drop("__h", "__g", "__cuts")


def running_totals(
    cells: DataFrame,
    keys: list[str],
    order: str,
    values: list[str],
    descending: bool = True,
    cells_per_task: int | None = None,
) -> DataFrame:
    """Inclusive running sums ``cum_<value>``, group totals ``all_<value>``, and ``next_<value>``.

    ``cells`` holds one row per distinct ``order`` value of a group, so copies
    of one score are already one row. Groups of up to ``cells_per_task`` cells
    take one window; larger ones are cut at approximate quantiles of ``order``,
    summed per bucket, and the bucket offsets added back. Both are exact.
    """
    limit = CELLS_PER_TASK if cells_per_task is None else cells_per_task
    kept = cells.persist(StorageLevel.MEMORY_AND_DISK)
    biggest = kept.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    direction = F.desc if descending else F.asc
    if biggest <= limit:
        w = W.partitionBy(*keys).orderBy(direction(order))
        running, whole = w.rowsBetween(W.unboundedPreceding, 0), W.partitionBy(*keys)
        return kept.select(
            "*",
            *[F.sum(v).over(running).alias(f"cum_{v}") for v in values],
            *[F.sum(v).over(whole).alias(f"all_{v}") for v in values],
            *[F.lead(v).over(w).alias(f"next_{v}") for v in values],
            *[F.lag(v).over(w).alias(f"prev_{v}") for v in values],
        )
    n_buckets = max(2, min(QUANTILE_BUCKETS, -(-biggest // max(1, limit // 2))))
    cut_points = [i / n_buckets for i in range(1, n_buckets)]
    bounds = kept.groupBy(*keys).agg(F.percentile_approx(order, cut_points, 10 * n_buckets).alias("__q"))
    placed = join_on(kept, small_side(bounds, 2_000), keys).withColumn(
        "__b", F.size(F.filter("__q", lambda q: q < F.col(order)))
    ).drop("__q")
    per_bucket = placed.groupBy(*keys, "__b").agg(
        *[F.sum(v).alias(f"__s_{v}") for v in values],
        *[(F.max_by if descending else F.min_by)(v, order).alias(f"__first_{v}") for v in values],
        *[(F.min_by if descending else F.max_by)(v, order).alias(f"__last_{v}") for v in values],
    )
    wb = W.partitionBy(*keys).orderBy(direction("__b"))
    before, whole = wb.rowsBetween(W.unboundedPreceding, -1), W.partitionBy(*keys)
    offsets = per_bucket.select(
        *keys, "__b",
        *[F.coalesce(F.sum(f"__s_{v}").over(before), F.lit(0)).alias(f"__off_{v}") for v in values],
        *[F.sum(f"__s_{v}").over(whole).alias(f"all_{v}") for v in values],
        *[F.lead(f"__first_{v}").over(wb).alias(f"__nb_{v}") for v in values],
        *[F.lag(f"__last_{v}").over(wb).alias(f"__pb_{v}") for v in values],
    )
    w = W.partitionBy(*keys, "__b").orderBy(direction(order))
    running = w.rowsBetween(W.unboundedPreceding, 0)
    out = join_on(placed, offsets, [*keys, "__b"]).select(
        *[F.col(f"`{c}`") for c in cells.columns],
        *[(F.sum(v).over(running) + F.col(f"__off_{v}")).alias(f"cum_{v}") for v in values],
        *[F.col(f"all_{v}") for v in values],
        *[F.coalesce(F.lead(v).over(w), F.col(f"__nb_{v}")).alias(f"next_{v}") for v in values],
        *[F.coalesce(F.lag(v).over(w), F.col(f"__pb_{v}")).alias(f"prev_{v}") for v in values],
    )
    return out


def expand_counts(df: DataFrame, count: str, index: str, block: int = 100_000, by: tuple[str, ...] = ()) -> DataFrame:
    """Repeat each row ``count`` times with ``index`` 0..count-1.

    A count of any size is spread: blocks first (one short row each), shuffled
    over the cluster, then the block's own indices. Where rows are many, ``by`` names the
    columns that tell them apart, so that their first blocks are spread too.
    """
    blocks = df.where(F.col(count) > 0).withColumn(
        "__block", F.explode(F.sequence(F.lit(0), F.floor((F.col(count) - 1) / F.lit(block)).cast("bigint")))
    )
    first = F.col("__block") * block
    last = F.least(first + block, F.col(count)) - 1
    return (
        blocks.repartition(*by, "__block")
        .withColumn(index, F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))))
        .drop("__block")
    )
