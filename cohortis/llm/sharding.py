"""Uniform shuffle into shards of exact size through a hypergeometric communication matrix."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortis.llm.common import Scratch

ROWS_PER_BUCKET = 500_000  # rows that one task ranks in the last permutation, about


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` rows, taken without replacement, are among the ``good`` ones.

    Inversion of the probabilities around the mode, by the ratio of neighbouring terms; the cut tails, beyond 14
    standard deviations and 60 steps, hold less than 1e-20. Populations may exceed what numpy's own generator takes.
    """
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    total = good + bad
    share = good / total
    spread = np.sqrt(max(draws * share * (1 - share) * (total - draws) / max(total - 1, 1), 1e-9))
    mode = min(max(int((draws + 1) * (good + 1) / (total + 2)), low), high)
    reach = int(14 * spread) + 60
    k = np.arange(max(low, mode - reach), min(high, mode + reach) + 1, dtype=np.float64)
    ratio = (good - k[:-1]) * (draws - k[:-1]) / ((k[1:]) * (bad - draws + k[1:]))
    logs = np.concatenate([[0.0], np.cumsum(np.log(ratio))])
    weights = np.cumsum(np.exp(logs - logs.max()))
    return int(k[min(np.searchsorted(weights, rng.random() * weights[-1], side="right"), len(k) - 1)])


def communication_matrix(sizes: list[int], capacities: list[int], seed: int) -> np.ndarray:
    """``matrix[p, s]``: rows of partition p that go to shard s in a uniformly random assignment.

    Row by row, each entry is a conditional hypergeometric draw from the room that the shards have left, so rows sum
    to the partition sizes and columns to the shard sizes.
    """
    rng = np.random.default_rng(seed)
    room = list(capacities)
    matrix = np.zeros((len(sizes), len(room)), np.int64)
    for p, size in enumerate(sizes):
        left, rest = size, sum(room)
        for s in range(len(room)):
            rest -= room[s]
            matrix[p, s] = hypergeometric(rng, room[s], rest, left)
            left -= int(matrix[p, s])
            room[s] -= int(matrix[p, s])
    return matrix


def shuffle_to_shards(df: DataFrame, shards: int, seed: int = 7) -> DataFrame:
    """All rows with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in its shard), uniformly shuffled.

    Shard sizes differ by one at most. Each input partition's rows are permuted, dealt to the shards by the matrix's
    exact counts, exchanged, and permuted again. A shard is ranked in buckets of its random keys, so no task holds a
    whole shard. The driver holds one count for each partition and shard; rows stay where Spark has them.

    Pass narrow rows (keys, digests) where texts need not move. Columns named ``shard`` or ``slot`` are replaced; any
    others, nulls and repeated rows pass through, and no row is compared with another. An empty table gives none.
    """
    scratch = Scratch(df.sparkSession, "shards")
    kept = [c for c in df.columns if c not in ("shard", "slot")]
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.spark_partition_id().alias("p"),
                       F.monotonically_increasing_id().alias("rid"))
    rows = scratch.write("rows", packed)
    sizes = rows.groupBy("p").count().orderBy("p").collect()
    total = sum(r["count"] for r in sizes)
    capacities = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = communication_matrix([r["count"] for r in sizes], capacities, seed)
    ends = matrix.cumsum(axis=1)
    plan = [(r["p"], s, int(ends[i, s] - matrix[i, s]), int(ends[i, s])) for i, r in enumerate(sizes)
            for s in range(shards)]
    ranges = df.sparkSession.createDataFrame(
        [(p, [(s, lo, hi) for q, s, lo, hi in plan[i * shards:(i + 1) * shards]]) for i, (p, *_) in
         enumerate(plan[::shards])], "p int, ranges array<struct<s:int,lo:long,hi:long>>")
    local = Window.partitionBy("p").orderBy(F.xxhash64(F.lit(seed), F.lit("local"), "rid"), "rid")
    dealt = (rows.withColumn("at", F.row_number().over(local) - 1)
             .join(ranges, "p")
             .withColumn("shard", F.expr("filter(ranges, x -> at >= x.lo and at < x.hi)[0].s"))
             .withColumn("key", F.xxhash64(F.lit(seed), F.lit("shard"), "rid")))
    buckets = max(64, -(-total // (shards * ROWS_PER_BUCKET)))
    # The key's order within the shard is (bucket, key): both are uniform, so the order is a uniform permutation.
    dealt = scratch.write("dealt", dealt.select(
        "row", "rid", "shard", "key", F.pmod(F.shiftright("key", 20), F.lit(buckets)).alias("bucket")))
    scratch.drop("rows")
    counts = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard", "bucket").orderBy("key", "rid")
    ranked = dealt.withColumn("at", F.row_number().over(within) - 1).join(bases, ["shard", "bucket"])
    return ranked.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], "shard", (F.col("base") + F.col("at")).alias("slot"))
