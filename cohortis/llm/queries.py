"""The corpus operators as registered queries over whole tables, and the SQL of those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortis.llm import (
    collocations, exact_dedup, line_dedup, mixing, packing, periodic, quality, sharding, simhash, sql, token_counts, topk,
    url_filter, vector_dedup,
)
from cohortis.llm.common import WORD, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"
SHARDS = 8
GOOD = 0.3  # least score of a document that is kept
MIX_WEIGHTS = [5, 2, 1]
TOKEN_LIMIT = 4096
RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def query(name: str, statement: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if statement is not None:
            SQL[name] = statement
        return fn
    return add


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(key: F.Column) -> F.Column:
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(True))


@query("op1_sharding")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    digests = table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32("text").cast("long").alias("text_crc32"), F.lit("rows").alias("law"))
    return sharding.shuffle_to_shards(digests, SHARDS).withColumn("grown_shard", F.lit(None).cast("int"))


@query("op2_vector_dedup", sql.VECTOR_DEDUP)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), 0.9)


@query("op3_quality")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id"))))
    scored = quality.score_quality(docs, model, keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= GOOD).cast("int").alias("predicted"))


@query("op4_simhash")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.simhash_groups(docs, width=3, distance=3).select("doc_id", "fingerprint", "component_id")


def packed(docs: DataFrame) -> DataFrame:
    """The pieces of ``docs`` with digests of their ids and their places in sequences."""
    with open(vocabulary(BYTE_BPE), encoding="utf-8") as f:
        pieces = packing.token_pieces(docs, f.read())
    return packing.pack(pieces.select(
        "doc_id", "start", "length", F.crc32("ids").cast("long").alias("ids_crc32"), "doc_tokens"))


@query("op5_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op6_topk", sql.TOP_K)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantise(table(spark, sf_dir, "embeddings"), 64.0, "embedding", "vec_id")
    return topk.top_k(vectors.filter(F.col("id") % 20 == 0), vectors, 20)


@query("op7_line_dedup", sql.LINE_DEDUP)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.withColumn("first_docs", F.array_join("first_docs", ","))


PAGE_OUTCOME = "bad"


def page_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url and ``bad`` of every page: the label of the document whose number its path holds, else null."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    _, path = url_filter.url_parts(F.col("url"))
    number = F.regexp_extract(path, r"/([0-9]{1,18})", 1)
    pages = pages.withColumn("doc", F.when(number != "", number.cast("long")))
    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    labels = (table(spark, sf_dir, "labels").filter("quality is not null or toxic is not null")
              .groupBy(F.col("doc_id").alias("doc")).agg(F.max(bad.cast("int")).alias(PAGE_OUTCOME)))
    return pages.join(labels, "doc", "left").drop("doc")


@query("op8_url_filter", sql.url_filter(RULES))
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.filter_urls(page_outcomes(spark, sf_dir), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", F.round("bad_rate", 6).alias("bad_rate"),
                         F.round("bad_lower", 6).alias("bad_lower"))


@query("op9_token_counts")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    with open(vocabulary(PIECE_BPE), "rb") as f:
        counted = token_counts.count_tokens(docs, f.read(), keep=["doc_id", "n_bytes"])
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@query("op10_mixing", sql.mixing(MIX_WEIGHTS))
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    plan = mixing.mix_plan(docs, MIX_WEIGHTS)
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op11_collocations", sql.COLLOCATIONS)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


@query("op12_exact_dedup", sql.EXACT_DEDUP)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text), the words of a tenth of them, chosen by crc32 of doc_id, made periodic from a place on."""
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    n = F.size("__words")
    start = g % n
    period = F.lit(1) + F.floor((n - start) / (F.lit(3) + g % 8))

    def source(i: F.Column) -> F.Column:
        return F.when(i >= F.col("__start"), F.col("__start") + (i - F.col("__start")) % F.col("__period")).otherwise(i)

    # The words of the other documents are an empty array, so their texts are not split here.
    split = docs.withColumn("__words", F.when(h % 10 == 0, words).otherwise(F.array().cast("array<string>")))
    placed = split.withColumns({"__start": F.when(n > 0, start), "__period": F.when(n > 0, period)})
    order = F.transform(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1), source)
    periodic_text = F.array_join(F.transform(order, lambda i: F.get("__words", i.cast("int"))), " ")
    return placed.withColumn("text", F.when(n > 0, periodic_text).otherwise(F.col("text"))).select("doc_id", "text")


@query("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic.collapse_runs(docs)
    # Runs come by start, then period, so of equal exponents the first is the one asked for.
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda b, r: F.when(
        r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("__best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("__best.start").alias("start"),
        F.col("__best.length").alias("length"), F.col("__best.period").alias("period"),
        F.call_function("div", F.col("__best.length") * 1000, F.col("__best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("collapsed_sha256"))
