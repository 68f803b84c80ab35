"""Shared helpers of the corpus operators: scratch tables, global prefix sums, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cohortis.session import ensure_checkpoint_dir

# A word is a run of bytes other than space and the five ASCII control spaces.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables that one operator call writes to the cluster's shared folder (``spark.checkpoint.dir``).

    Writing a table cuts its lineage, so a lost executor costs one step, not the whole job. Writing a name again
    deletes the version before it once the new one is complete. The last versions stay: results are read from them.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark)}/{tag}-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}

    def write(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        old = self.paths.pop(name, None)
        if old is not None:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(old)
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def running_total(scratch: Scratch, name: str, df: DataFrame, order: list[str], weight: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``weight`` over all rows before this one in the order of ``order``.

    The rows are range-partitioned and sorted, each task sums its own range, and the ranges' totals (one row for each
    shuffle partition) give the bases. No task sees more than its range, whatever the keys. Rows equal in ``order``
    follow one another in any order.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.LongType()), T.StructField("__range", T.IntegerType())])
    position = df.columns.index(weight)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            weights = batch.column(position).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = total + np.cumsum(weights)
            columns = [*batch.columns, pa.array(ends - weights), pa.array(np.full(len(weights), part, np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)
            total = int(ends[-1]) if len(ends) else total

    local = scratch.write(name, ranged.mapInArrow(scan, schema))
    totals = local.groupBy("__range").agg(F.sum(weight).alias("__total"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("__range", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__base"))
    return local.join(F.broadcast(bases), "__range").withColumn(out, F.col(out) + F.col("__base")).select(*df.columns, out)


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b), the component being its smallest node.

    Alternates the large-star and small-star steps of Kiveris et al. (2014) until the edges stay the same. Each step
    is an aggregation and an equi-join whose result goes to the shared folder; the number of rounds grows with the
    logarithm of the component sizes, and a hub's edges are spread over the join's skew splits.
    """
    spark = scratch.spark
    now = scratch.write("edges", _canonical(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            break
        seen = state
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        lows = scratch.write("lows", both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low")))
        large = both.filter("v > u").join(lows, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        now = scratch.write("edges", _canonical(large))
        lows = scratch.write("lows", now.groupBy("a").agg(F.min("b").alias("low")))
        small = now.join(lows, "a").select(F.col("b").alias("u"), F.col("low").alias("v"))
        now = scratch.write("edges", _canonical(small.union(lows)))
    scratch.drop("lows")
    if seen is None:
        return spark.createDataFrame([], "node long, component long")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _canonical(edges: DataFrame) -> DataFrame:
    return edges.filter("u <> v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct()


class Forest:
    """Union-find over 0..n-1 that keeps the links which joined two sets: a spanning forest of all links added."""

    def __init__(self, n: int):
        self.label = np.arange(n)  # the smallest member of each one's set
        self.links: list[tuple[int, int]] = []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Adds the links a[i] - b[i]; links within one set cost no more than a comparison."""
        apart = self.label[a] != self.label[b]
        a, b = a[apart], b[apart]
        _, first = np.unique(self.label[a] * len(self.label) + self.label[b], return_index=True)
        parent = self.label.tolist()

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        joined = False
        for p, q in zip(a[first].tolist(), b[first].tolist()):
            x, y = find(p), find(q)
            if x != y:
                parent[max(x, y)] = min(x, y)
                self.links.append((p, q))
                joined = True
        if joined:
            self.label = np.array([find(x) for x in range(len(parent))])


def ascii_lower(c: Column) -> Column:
    """A-Z only, as byte-wise lower-casing does."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def n_words(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")
