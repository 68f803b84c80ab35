"""Session helpers: a local session for tests, reliable checkpoints, size-checked broadcast."""

from __future__ import annotations

import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest helper table (rows) that may be broadcast. The tables it guards are
# narrow (class counts, bucket offsets, cut points), so this stays within tens of MB.
BROADCAST_ROWS = 200_000
# Partitions a core from which uneven ones and a last round that does not fill the cores are a small share of a pass.
MANY_ROUNDS = 8


def local_session(name: str = "cohortis", cores: str | int = "*", **conf: str) -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        # Wide encodings make generated methods the JIT refuses (over 8000 bytes of bytecode);
        # with this limit Spark uses per-operator code there, which measured twice as fast.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster; a private one only in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        configured = tempfile.mkdtemp(prefix="cohortis-checkpoint-")
    sc.setCheckpointDir(configured)
    return configured


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder, so lost executors lose nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, key: str, partitions: int) -> DataFrame:
    """Use every core to the end of a pass: deal the rows of ``partitions`` partitions evenly by key, in whole rounds of the cores.

    A pass lasts until its largest partition is done, and a few partitions more than cores cost a whole round of tasks.
    Meant for frames that are checkpointed next, before iterative fits; a frame of many rounds is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if partitions >= MANY_ROUNDS * cores:
        return df
    return df.repartition(cores * -(-partitions // cores), key)


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` only when its row count proves small; otherwise leave the join to AQE.

    The rows are persisted so that the count and the join share one computation.
    """
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    if kept.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(kept)
    return kept


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` treating null keys as equal; the right copies of the keys are dropped."""
    renamed = right
    condition = None
    for key in keys:
        renamed = renamed.withColumnRenamed(key, f"__r_{key}")
        part = left[f"`{key}`"].eqNullSafe(renamed[f"`__r_{key}`"])
        condition = part if condition is None else condition & part
    return left.join(renamed, condition, how).drop(*[f"__r_{key}" for key in keys])
