"""Stand-ins for the study tables over a star schema (orders, lines, customers, parts).

Each view is one table of column expressions in SQL common to Spark and other
engines, so the same definition serves the Spark query and its SQL check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def parallel(df: DataFrame) -> DataFrame:
    """Spread a scan that has fewer splits than cores (a few small files); larger scans stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _flag(test: str) -> str:
    return f"case when {test} then 'Y' else 'N' end"


def _flag_or_null(null_when: str, test: str) -> str:
    return f"case when {null_when} then null when {test} then 'Y' else 'N' end"


ROW_ID = (
    "concat_ws(':', cast(l_orderkey as string), cast(l_linenumber as string), cast(l_partkey as string), "
    "cast(l_suppkey as string), cast(cast(l_shipdate as date) as string))"
)

CASE_COLUMNS = {
    "row_id": ROW_ID,
    "pid": "cast(o_custkey as string)",
    "cohort": "c_mktsegment",
    "sex": "case when l_linestatus = 'F' then 'F' else 'M' end",
    "age_init": "cast(p_size as double)",
    "lesion": "case when l_partkey % 17 = 0 then null when l_partkey % 13 = 0 then 'NO RECORD' "
              "when l_partkey % 19 = 0 then 'no record' when l_returnflag = 'R' then 'E' else l_returnflag end",
    "eeg_cat": "case when o_orderkey % 29 = 0 then null when o_orderkey % 23 = 0 then '无记录' "
               "when o_orderkey % 31 = 0 then 'no record' when o_orderkey % 37 = 0 then '缺' "
               "when o_orderstatus = 'F' then 'A' when o_orderstatus = 'O' then 'E' else 'N' end",
    "pretrt_sz_5": "case when l_suppkey % 37 = 0 then '9' when l_suppkey % 41 = 0 then null "
                   "when l_quantity > 25 then 'Y' else 'N' end",
    "focal": _flag_or_null("o_orderkey % 61 = 0", "l_linenumber % 2 = 0"),
    "fam_hx": _flag_or_null("l_partkey % 43 = 0", "l_discount > 0.05"),
    "febrile": _flag_or_null("l_orderkey % 47 = 0", "l_tax > 0.04"),
    "ci": _flag_or_null("l_partkey % 53 = 0", "(l_orderkey + l_linenumber) % 3 = 0"),
    "birth_t": _flag("(l_partkey + l_linenumber) % 2 = 0"),
    "head": "case when o_custkey % 53 = 0 then 'Unconscious after falling at the age of 4' "
            "when o_custkey % 2 = 0 then 'Y' else 'N' end",
    "drug": _flag("l_suppkey % 5 = 0"),
    "alcohol": _flag_or_null("l_suppkey % 59 = 0", "l_partkey % 4 = 0"),
    "cvd": _flag_or_null("l_orderkey % 67 = 0", "l_extendedprice > 50000"),
    "psy": _flag_or_null("l_partkey % 71 = 0", "l_quantity > 40"),
    "ld": _flag_or_null("o_custkey % 73 = 0", "o_totalprice > 250000"),
    "asm": "case l_partkey % 9 when 0 then 'CBZ' when 1 then 'LEV' when 2 then 'LTG' when 3 then 'OXC' "
           "when 4 then 'PHT' when 5 then 'TPM' when 6 then 'VPA' when 7 then p_type else null end",
    "outcome_12m": "case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'Seizure-free' "
                   "when o_orderpriority = '3-MEDIUM' then 'Not seizure-free' else '2' end",
}

CASES_FROM = (
    "lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey "
    "join part on l_partkey = p_partkey"
)
LABEL_EXPR = "case when o_orderpriority in ('1-URGENT', '2-HIGH') then 1 else 0 end"
TIED_SCORE = "cast((l_partkey * 7919 + l_orderkey * 104729 + l_linenumber * 31) % 1000 as double) / 1e3"
SIGNAL_SCORE = f"least(1e0, {TIED_SCORE} + 2e-1 * ({LABEL_EXPR}))"


def select_sql(columns: dict[str, str], source: str) -> str:
    return "select " + ", ".join(f"{e} as {n}" for n, e in columns.items()) + " from " + source


CASES_SQL = "cases as (" + select_sql(CASE_COLUMNS, CASES_FROM) + ")"

SCORE_COLUMNS = {"cohort": "c_mktsegment", "row_id": ROW_ID, "label": LABEL_EXPR}
SCORES_SQL = (
    "scores as ("
    + select_sql({"model": "'signal'", **SCORE_COLUMNS, "score": SIGNAL_SCORE}, CASES_FROM)
    + " union all "
    + select_sql({"model": "'tied'", **SCORE_COLUMNS, "score": TIED_SCORE}, CASES_FROM)
    + ")"
)

CASE_ORDER_COLUMNS = {
    "case_id": "o_orderkey",
    "pid": "o_custkey",
    "cohort": "c_mktsegment",
    "label": "case when o_orderstatus = 'F' then 1 else 0 end",
    "price": "o_totalprice",
}
CASE_ORDERS_FROM = "orders join customer on o_custkey = c_custkey"
CASE_ORDERS_SQL = "case_orders as (" + select_sql(CASE_ORDER_COLUMNS, CASE_ORDERS_FROM) + ")"

DOC_COLUMNS = {
    "doc_id": "doc_id",
    "label": "cast(quality as int)",
    "score": "cast((doc_id * 37) % 101 as double) / 1e2",
}
DOCS_SQL = "labelled_docs as (" + select_sql(DOC_COLUMNS, "labels") + ")"


def star(spark: SparkSession, sf: str) -> DataFrame:
    line, orders = load(spark, sf, "lineitem"), load(spark, sf, "orders")
    customer, part = load(spark, sf, "customer"), load(spark, sf, "part")
    return (
        line.join(orders, line.l_orderkey == orders.o_orderkey)
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
    )


def cases(spark: SparkSession, sf: str) -> DataFrame:
    """Raw patient table."""
    return star(spark, sf).selectExpr(*[f"{e} as {n}" for n, e in CASE_COLUMNS.items()])


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions of two models: one with signal, one with heavy ties and none. One scan of the star."""
    base = star(spark, sf).selectExpr(
        *[f"{e} as {n}" for n, e in SCORE_COLUMNS.items()],
        f"array(named_struct('model', 'signal', 'score', {SIGNAL_SCORE}), "
        f"named_struct('model', 'tied', 'score', {TIED_SCORE})) as outputs",
    )
    return base.selectExpr("cohort", "row_id", "label", "inline(outputs)").select(
        "model", "cohort", "row_id", "label", "score"
    )


def case_orders(spark: SparkSession, sf: str) -> DataFrame:
    """One row per order: unique key, cohort, label."""
    orders, customer = load(spark, sf, "orders"), load(spark, sf, "customer")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey)
    return joined.selectExpr(*[f"{e} as {n}" for n, e in CASE_ORDER_COLUMNS.items()])


def labelled_docs(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "labels").selectExpr(*[f"{e} as {n}" for n, e in DOC_COLUMNS.items()])


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """(vec_id, label, x array<double>)."""
    return parallel(load(spark, sf, "embeddings")).select(
        "vec_id", F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("x")
    )
