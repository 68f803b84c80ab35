"""Line dedup: a suffix array over line ids, built by distributed prefix doubling, finds repeated runs of lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortis.llm.common import Scratch, running_total

MIN_WORDS = 5  # words of the shortest run that is worth deleting


def _lines(rows: DataFrame, min_words: int) -> DataFrame:
    """(rid, line, hi, lo, left, right, remaining) of each line of ``rows`` (rid, text).

    ``hi`` and ``lo`` are the line's 128-bit id. ``left`` is the number of lines of the shortest run that starts here
    and has ``min_words`` words, ``right`` that of the shortest such run that ends here; 0 if there is none in the
    document. ``remaining`` counts the lines from here to the end.
    """
    schema = "rid long, line int, hi long, lo long, left int, right int, remaining int"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lines = text.encode().split(b"\n")
                ids = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x) for x in lines), np.int64).reshape(-1, 2)
                ends = np.cumsum([len(x.split()) for x in lines])
                starts = np.concatenate([[0], ends[:-1]])
                at = np.arange(len(lines))
                last = np.searchsorted(ends, starts + min_words)  # the line that completes a run from here
                left = np.where(last < len(lines), last - at + 1, 0)
                opening = np.searchsorted(starts, ends - min_words, side="right") - 1
                right = np.where(ends >= min_words, at - opening + 1, 0)
                parts.append((np.full(len(lines), rid), at, ids[:, 0], ids[:, 1], left, right, len(lines) - at))
            if parts:
                columns = [np.concatenate(c) for c in zip(*parts)]
                types = (np.int64, np.int32, np.int64, np.int64, np.int32, np.int32, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(columns, types)],
                                                 names=[f.split()[0] for f in schema.split(", ")])

    return rows.mapInArrow(scan, schema)


def repeated_runs(lines: DataFrame, scratch: Scratch) -> DataFrame:
    """(pos, lines, first): the shortest runs of enough words that also occur at the earlier place ``first``.

    ``lines`` has pos (place in the whole corpus, documents one after another), hi, lo, left, right and remaining.

    Prefix doubling over the suffixes of the corpus' line-id sequences: a suffix's rank by its first 2h lines comes
    from its rank by the first h and that of the suffix h lines further on; the new rank is the running count of the
    ordered pairs, so it is the start of the suffix's interval in the suffix array. Suffixes of one rank are an
    interval whose longest common prefix has h lines or more; two overlapping ranks of a level tell equal runs of any
    length from h to 2h. A suffix that shares its first h lines with no other leaves the array, as does one that ends
    before, since neither can start a longer repeated run. The doubling ends at the longest run that has to be
    decided. In each interval the first place in the corpus is the original.
    """
    keys = lines.groupBy("hi", "lo").agg(F.count("*").alias("n")).filter("n > 1")
    keys = running_total(scratch, "keys", keys, ["hi", "lo"], "n", "rank").drop("n")
    base = scratch.write("base", lines.join(keys, ["hi", "lo"]).drop("hi", "lo"))
    runs = base.filter("left > 0").select("pos", F.col("left").alias("lines")).union(
        base.filter("right > 0").select(F.col("pos") - F.col("right") + 1, "right"))
    runs = scratch.write("runs", runs.distinct())
    longest = runs.agg(F.max("lines")).first()[0] or 0
    ranks, h, found = base.select("pos", "rank", "remaining"), 1, None
    while h <= longest:
        level = runs.filter(F.col("lines").between(h, 2 * h - 1))
        heads = ranks.select("pos", F.col("rank").alias("r1"))
        tails = ranks.select((F.col("pos") + h).alias("end"), F.col("rank").alias("r2"))
        named = level.join(heads, "pos").withColumn("end", F.col("pos") + F.col("lines")).join(tails, "end")
        named = scratch.write("named", named.select("pos", "lines", "r1", "r2"))
        firsts = named.groupBy("lines", "r1", "r2").agg(F.min("pos").alias("first"), F.count("*").alias("n"))
        firsts = scratch.write("firsts", firsts.filter("n > 1").drop("n"))
        later = named.join(firsts, ["lines", "r1", "r2"]).filter("pos > first").select("pos", "lines", "first")
        later = scratch.write(f"later{h}", later)
        found = later if found is None else found.unionByName(later)
        if 2 * h <= longest:
            nexts = ranks.select((F.col("pos") - h).alias("pos"), F.col("rank").alias("r2"))
            pairs = scratch.write("pairs", ranks.filter(F.col("remaining") >= 2 * h).join(nexts, "pos"))
            keys = pairs.groupBy(F.col("rank").alias("r1"), "r2").agg(F.count("*").alias("n")).filter("n > 1")
            keys = running_total(scratch, "keys", keys, ["r1", "r2"], "n", "new").drop("n")
            deeper = pairs.withColumnRenamed("rank", "r1").join(keys, ["r1", "r2"])
            ranks = scratch.write("ranks", deeper.select("pos", F.col("new").alias("rank"), "remaining"))
        h *= 2
    if found is None:
        found = runs.select("pos", "lines", F.col("pos").alias("first")).limit(0)
    return found


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with ``text`` less its repeated lines, and n_lines, n_removed and first_docs (replaced if present).

    A line goes if it lies in a run of consecutive lines, with ``min_words`` words or more in all, that also occurs at
    an earlier place: in a document of smaller id or further up in the same one. The first copy of a run stays. Lines
    are the parts between newlines, compared byte by byte (through 128-bit ids); the runs of a document never reach
    into the next. ``first_docs`` lists the ids (sorted, distinct) of the documents that hold the first copies.

    Rows of one id are ordered by a hash of their text; rows with a null id come last. A null text stays null and has
    no lines. An empty text has one line, which stays, as do blank lines outside repeated runs. A document that loses
    every line keeps a row with an empty text. An empty table gives none.
    """
    if min_words < 1:
        raise ValueError("min_words must be 1 or more")
    scratch = Scratch(docs.sparkSession, "lines")
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed", "first_docs")]
    length = F.length(F.col(text)) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1
    rows = scratch.write("rows", docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept if c != text]).alias("row"), F.col(key).cast("long").alias("id"),
        F.col(text).alias("text"), F.monotonically_increasing_id().alias("rid"), F.xxhash64(F.col(text)).alias("h"),
        length.cast("long").alias("n")))
    heads = rows.filter("n is not null").select(
        F.col("id").isNull().alias("none"), F.coalesce("id", F.lit(0)).alias("id"), "h", "rid", "n")
    order = ["none", "id", "h", "rid"]
    starts = running_total(scratch, "starts", heads, order, "n", "start").select("rid", "start", "none", "id")
    lines = scratch.write("lines", _lines(rows.filter("text is not null").select("rid", "text"), min_words))
    found = lines.groupBy("hi", "lo").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    places = lines.join(scratch.write("repeated", found), ["hi", "lo"]).join(starts.select("rid", "start"), "rid").select(
        (F.col("start") + F.col("line")).alias("pos"), "hi", "lo", "left", "right", "remaining", "rid", "line")
    places = scratch.write("places", places)
    scratch.drop("lines")
    scratch.drop("repeated")
    runs = repeated_runs(places.drop("rid", "line"), scratch)
    owner = places.select("pos", "rid", "line")
    source = places.select(F.col("pos").alias("first"), F.col("rid").alias("source"))
    ids = starts.select(F.col("rid").alias("source"), F.when(~F.col("none"), F.col("id")).alias("source_id"))
    later = runs.join(owner, "pos").join(source, "first").join(ids, "source")
    cuts = later.groupBy(F.col("rid").alias("cut_rid")).agg(
        F.collect_list(F.struct("line", "lines")).alias("cuts"), F.sort_array(F.collect_set("source_id")).alias("first_docs"))
    cuts = scratch.write("cuts", cuts)
    joined = rows.join(cuts.hint("shuffle_hash"), rows.rid == cuts.cut_rid, "left").select(
        "row", "text", "cuts", F.coalesce("first_docs", F.array().cast("array<long>")).alias("first_docs"))
    schema = joined.select("row", "first_docs", "text", F.lit(0).alias("n_lines"), F.lit(0).alias("n_removed")).schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, totals, gone = [], [], []
            for value, drops in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                total, less = 0 if value is None else value.count("\n") + 1, 0
                if drops:
                    edges = np.zeros(total + 1, np.int64)
                    np.add.at(edges, [d["line"] for d in drops], 1)
                    np.add.at(edges, [d["line"] + d["lines"] for d in drops], -1)
                    stays = np.cumsum(edges)[:-1] == 0
                    value = "\n".join(x for x, stay in zip(value.split("\n"), stays) if stay)
                    less = int(total - stays.sum())
                texts.append(value)
                totals.append(total)
                gone.append(less)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(3), pa.array(texts, pa.string()), pa.array(totals, pa.int32()),
                 pa.array(gone, pa.int32())], names=schema.names)

    done = joined.mapInArrow(cut, schema)
    return done.select(*[F.col("text").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in kept],
                       "n_lines", "n_removed", "first_docs")
