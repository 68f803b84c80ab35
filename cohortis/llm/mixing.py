"""Mixing sources to target weights: capped water-filling and seeded repetitions, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortis.functions.keyed import HASH_BITS, keyed_hash
from cohortis.llm.common import Scratch, n_words

PART_BITS = 10  # of a coarse bucket, and again of the fine buckets in it
LARGE_SHARE = 2000  # a document of more than this part of its source is large; a source has fewer than this many
PLACE = ("place", "id", "size", "rid")  # the seeded order of a source's documents
ALL, NONE = 1 << HASH_BITS, -1  # cuts behind and before every bucket


def water_fill(sources: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """``target`` for each row of ``sources`` (with ``weight`` and ``source_size``).

    The targets share ``share`` times all sizes by weight. A source above ``max_epochs`` times its size is clamped
    there and its excess goes to the others by weight, round after round until none is above. Only the sums of a round
    reach the driver. A source of size 0 gets 0; if every source is clamped, all stay at their caps.
    """
    size, cap = F.col("source_size"), F.col("source_size") * F.lit(float(max_epochs))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    clamped = F.lit(False)
    while True:
        open_weight, closed, n = sources.agg(
            F.sum(F.when(~clamped, F.col("weight"))), F.sum(F.when(clamped, cap)), F.count(F.when(clamped, 1))).first()
        if not open_weight:
            return sources.withColumn("target", F.when(size > 0, cap).otherwise(0.0))
        level = (share * total - (closed or 0.0)) / open_weight
        over = F.col("weight") * F.lit(level) > cap
        if sources.filter(over).count() == n:
            return sources.withColumn("target", F.when(clamped, cap).otherwise(F.col("weight") * F.lit(level)))
        clamped = over  # the level only rises, so this holds every source clamped before


def _planned(docs: DataFrame, weights: list[int], share: float, max_epochs: float, seed: int, text: str, source: str,
             key: str, carry: list[str]) -> DataFrame:
    """id, src, size, source_size, target, copies and the ``carry`` columns prefixed by ``c_``, one row a document."""
    scratch = Scratch(docs.sparkSession, "mix")
    most = math.ceil(max_epochs)
    place = keyed_hash(seed, "mix", F.coalesce(F.col(key).cast("string"), F.lit("null")))
    sized = docs.select(F.col(key).alias("id"), F.col(source).alias("src"), n_words(F.col(text)).alias("size"),
                        place.alias("place"), *[F.col(f"`{c}`").alias(f"c_{c}") for c in carry])
    rows = scratch.write("rows", sized.withColumn("bucket", F.shiftright("place", HASH_BITS - 2 * PART_BITS))
                         .withColumn("rid", F.monotonically_increasing_id()))
    sizes = rows.groupBy("src").agg(F.sum("size").alias("source_size"))
    # One row a source: their turns need an order over the sources, not over the documents.
    turn = F.row_number().over(Window.orderBy(F.col("src").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    sources = scratch.write("sources", sizes.withColumn("weight", weight))
    filled = scratch.write("filled", water_fill(sources, share, max_epochs).select("src", "source_size", "target"))
    lean = rows.select("id", "src", "size", "place", "bucket", "rid")
    known = lean.alias("r").join(filled.alias("f"), F.expr("r.src <=> f.src")).select("r.*", "source_size")
    large = known.filter(F.col("size") * LARGE_SHARE > F.col("source_size"))
    listed = large.groupBy("src").agg(F.array_sort(F.collect_list(
        F.struct(F.negative("size").alias("order"), *PLACE))).alias("docs"))
    chosen = scratch.write("chosen", filled.alias("f").join(listed.alias("l"), F.expr("f.src <=> l.src"), "left").select(
        "f.src", _choose_large(most).alias("plan")))
    # What the large documents leave of the target goes to the others: whole repetitions, and a part of one more.
    left, room = F.col("plan.left"), F.col("plan.room")
    factor = F.when(room > 0, F.least(F.greatest(left / room, F.lit(0.0)), F.lit(float(most)))).otherwise(0.0)
    shares = scratch.write("shares", chosen.select("src", F.floor(factor).alias("whole"), left.alias("left"), room.alias("room")).select(
        "src", "whole", F.when(F.col("whole") < most, F.greatest(F.col("left") - F.col("whole") * F.col("room"), F.lit(0.0)))
        .otherwise(0.0).alias("rest")))
    ends = _last_taken(scratch, known.filter(F.col("size") * LARGE_SHARE <= F.col("source_size")).drop("source_size"), shares)
    few = chosen.select(F.explode("plan.copies").alias("c")).select("c.rid", "c.copies")
    full = rows.alias("r").join(filled.alias("f"), F.expr("r.src <=> f.src")).select("r.*", "source_size", "target")
    is_large = F.col("size") * LARGE_SHARE > F.col("source_size")
    reached = (F.col("bucket") < F.col("cut")) | (
        (F.col("bucket") == F.col("cut")) & F.coalesce(F.struct(*PLACE) <= F.col("last"), F.lit(False)))
    others = full.filter(~is_large).alias("r").join(ends.alias("e"), F.expr("r.src <=> e.src")).select(
        "r.*", "whole", "cut", "last").withColumn("copies", F.col("whole") + reached.cast("long"))
    kept = ["id", "src", "size", "source_size", "target", "copies", *[f"`c_{c}`" for c in carry]]
    return others.select(*kept).unionByName(full.filter(is_large).join(few, "rid").select(*kept))


def _choose_large(most: int) -> Column:
    """left, room and copies (rid, copies) after the large documents of a source, from the largest down.

    ``left`` is what is left of the target and ``room`` the size of the documents not yet decided, each of which may be
    taken up to ``most`` times. A document gets the number of copies after which the rest can still meet the target, or
    miss it least, and of those the one nearest to ``left / room``.
    """
    empty = F.array().cast("array<struct<rid: bigint, copies: bigint>>")
    start = F.struct(F.col("target").alias("left"), F.col("source_size").alias("room"), empty.alias("copies"))

    def decide(acc: Column, doc: Column) -> Column:
        after = acc["room"] - doc["size"]

        def option(c: int) -> Column:
            rest = acc["left"] - c * doc["size"]
            miss = F.greatest(F.lit(0.0), -rest, rest - most * after)
            return F.struct(miss, F.abs(F.lit(float(c)) - acc["left"] / acc["room"]), F.lit(c).cast("long").alias("copies"))

        copies = F.array_min(F.array(*[option(c) for c in range(most + 1)]))["copies"]
        taken = F.struct(doc["rid"].alias("rid"), copies.alias("copies"))
        return F.struct((acc["left"] - copies * doc["size"]).alias("left"), after.alias("room"),
                        F.concat(acc["copies"], F.array(taken)).alias("copies"))

    sizes = F.transform("docs", lambda d: F.struct(d["size"].alias("size"), d["rid"].alias("rid")))
    none = F.array().cast("array<struct<size: bigint, rid: bigint>>")
    return F.aggregate(F.coalesce(sizes, none), start, decide)


def _last_taken(scratch: Scratch, pool: DataFrame, shares: DataFrame) -> DataFrame:
    """(src, whole, cut, last): documents up to ``last`` of the bucket ``cut`` in the seeded order are taken once more.

    ``pool`` holds the documents that are not large, ``shares`` (src, whole, rest) what each source still needs. The
    running size is taken over coarse buckets, then over the fine ones of the bucket in which the cut falls, then over
    the rows of one fine bucket: no task orders a whole source. The document at the cut is taken if that comes nearer.
    """
    coarse = F.shiftright("bucket", PART_BITS)
    wide = scratch.write("wide", _cut(
        pool.groupBy("src", coarse.alias("part")).agg(F.sum("size").alias("within")),
        shares.select("src", "rest", F.lit(0).cast("long").alias("base"))))
    inside = pool.alias("r").join(wide.alias("w"), F.expr("r.src <=> w.src") & (coarse == F.col("cut")))
    cut = scratch.write("cut", _cut(
        inside.groupBy(F.col("r.src").alias("src"), F.col("bucket").alias("part")).agg(F.sum("size").alias("within")),
        wide.drop("cut")))
    edge = pool.alias("r").join(cut.alias("k"), F.expr("r.src <=> k.src and r.bucket = k.cut")).select("r.*", "base", "rest")
    order = Window.partitionBy("src").orderBy(*PLACE).rowsBetween(Window.unboundedPreceding, 0)
    upto, rest = F.col("upto"), F.col("rest")
    last = edge.withColumn("upto", F.col("base") + F.sum("size").over(order)).filter(
        upto - rest < rest - (upto - F.col("size"))).groupBy("src").agg(F.max(F.struct(*PLACE)).alias("last"))
    limit = F.when(F.col("s.rest") > 0, F.coalesce("k.cut", F.lit(ALL))).otherwise(NONE).cast("long").alias("cut")
    return scratch.write("ends", shares.alias("s").join(cut.alias("k"), F.expr("s.src <=> k.src"), "left")
                         .join(last.alias("l"), F.expr("s.src <=> l.src"), "left").select("s.src", "s.whole", limit, "l.last"))


def _cut(sums: DataFrame, bounds: DataFrame) -> DataFrame:
    """(src, cut, base, rest): the first part at whose end the running size is over ``rest``, and the size before it.

    ``sums`` holds (src, part, within), ``bounds`` (src, rest, base). Sources that never pass their rest are left out.
    """
    running = Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("upto", F.sum("within").over(running))
    joined = sums.alias("s").join(bounds.alias("b"), F.expr("s.src <=> b.src"))
    upto = F.col("base") + F.col("upto")
    return joined.filter(upto > F.col("rest")).groupBy(F.col("s.src").alias("src")).agg(
        F.min("part").alias("cut"), F.min_by(upto - F.col("within"), "part").alias("base"), F.first("rest").alias("rest"))


def mix_plan(docs: DataFrame, weights: list[int], share: float = 1.5, max_epochs: float = 2.0, seed: int = 11,
             text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """Per document: ``key``, ``source``, size (words), source_size, target (of its source) and copies.

    Sources in code point order, null last, take ``weights`` in turn. A document larger than 1 / LARGE_SHARE of its
    source gets its number of copies on its own, the largest first, so that the documents behind it can make up for
    what its size leaves over; a large document may thus displace copies of smaller ones. What is left of the target is
    spread over the other documents: each is repeated as often as it goes into their size, and the rest of it is filled
    with one more repetition of those that come first in a seeded order. So a target that documents can meet is missed
    by half a document at most, one smaller than 1 / LARGE_SHARE of its source or the source's smallest.

    No task orders a whole source: large ones are fewer than LARGE_SHARE, the others are cut by hash buckets. Reruns
    agree, since the order is a keyed hash of the document id.

    A null or empty text has size 0 and adds nothing. Rows with one id are separate rows at one place of the order,
    the smaller first. An empty table gives an empty plan.
    """
    planned = _planned(docs, weights, share, max_epochs, seed, text, source, key, [])
    return planned.withColumnsRenamed({"id": key, "src": source})


def mix_documents(docs: DataFrame, weights: list[int], share: float = 1.5, max_epochs: float = 2.0, seed: int = 11,
                  text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as ``mix_plan`` says, with its columns and no others."""
    planned = _planned(docs, weights, share, max_epochs, seed, text, source, key, docs.columns)
    repeated = planned.filter("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return repeated.select(*[F.col(f"`c_{c}`").alias(c) for c in docs.columns])
