"""Exact top-k inner-product search by block-at-a-time pruning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortis.llm.common import Scratch

BLOCK = 64  # candidates of a block; its term maxima bound their scores
RANGE_ROWS = 8192  # candidates of a document range, searched by one task for one set of queries
QUERY_ROWS = 1024  # queries of a set
EXACT = 2.0**53


def quantise(vectors: DataFrame, scale: float, vector: str, key: str) -> DataFrame:
    """(id, v array<long>): floor(scale * x) of each component; rows with null or non-finite components are left out."""
    values = F.transform(F.col(vector), lambda x: x.cast("double"))
    valid = (F.size(vector) > 0) & F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (vectors.filter(F.col(key).isNotNull() & F.coalesce(valid, F.lit(False)))
            .select(F.col(key).cast("long").alias("id"), F.transform(values, lambda x: F.floor(x * scale)).alias("v")))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten() if not isinstance(column, pa.ChunkedArray) else column.combine_chunks().flatten()
    return flat.to_numpy().reshape(len(column), -1)


def search(queries: np.ndarray, query_ids: np.ndarray, docs: np.ndarray, ids: np.ndarray, k: int,
           skip_self: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, candidate id, score) of each query's k best in one document range, ties to the smaller id.

    Terms are the components split by sign. A block's bound for a query adds up its term maxima times the query's
    weights. Each query takes the blocks in falling order of its bounds, in waves of growing size; a block is scored
    through its own rows for all queries of the wave that want it, and a query stops at the first block whose bound is
    below its k-th score (blocks whose bound equals it may hold a smaller id).
    """
    n_blocks = -(-len(docs) // BLOCK)
    starts = np.arange(n_blocks) * BLOCK
    highs, lows = np.maximum.reduceat(docs, starts), np.minimum.reduceat(docs, starts)
    most = int(np.abs(queries).max(initial=0)) * int(np.abs(docs).max(initial=0)) * docs.shape[1]
    number = np.float64 if most < EXACT else np.int64
    queries, docs, highs, lows = (x.astype(number) for x in (queries, docs, highs, lows))
    zero = number(0)
    bounds = np.maximum(queries, zero) @ np.maximum(highs, zero).T + np.minimum(queries, zero) @ np.minimum(lows, zero).T
    # Where all of a block has one sign the nearest value bounds the opposite term too.
    bounds += np.minimum(queries, zero) @ np.maximum(lows, zero).T + np.maximum(queries, zero) @ np.minimum(highs, zero).T
    order = np.argsort(-bounds, axis=1, kind="stable")
    lowest = number(-np.inf) if number is np.float64 else np.iinfo(np.int64).min
    kth = np.full(len(queries), lowest)
    best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, number)]
    at, wave = 0, 1
    active = np.arange(len(queries))
    while at < n_blocks and len(active):
        wanted = order[active, at:at + wave]
        open_ = np.take_along_axis(bounds[active], wanted, axis=1) >= kth[active][:, None]
        asker, column = np.nonzero(open_)
        block = wanted[asker, column]
        asker = active[asker]
        by_block = np.argsort(block, kind="stable")
        asker, block = asker[by_block], block[by_block]
        found = [[best[0]], [best[1]], [best[2]]]
        edges = np.flatnonzero(np.diff(block, prepend=-1, append=-1)) if len(block) else []
        for lo, hi in zip(edges[:-1], edges[1:]):
            own, first = asker[lo:hi], block[lo] * BLOCK
            scores = queries[own] @ docs[first:first + BLOCK].T
            keep = scores >= kth[own][:, None]
            if skip_self:
                keep &= query_ids[own][:, None] != ids[first:first + BLOCK][None, :]
            q, d = np.nonzero(keep)
            found[0].append(own[q])
            found[1].append(ids[first + d])
            found[2].append(scores[q, d])
        q, d, s = (np.concatenate(x) for x in found)
        rank = np.lexsort((d, -s, q))
        q, d, s = q[rank], d[rank], s[rank]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == k - 1
        kth[q[last]] = s[last]
        best = [x[place < k] for x in (q, d, s)]
        at += wave
        wave *= 2
        if at < n_blocks:
            active = active[bounds[active, order[active, at]] >= kth[active]]
    return best[0], best[1], best[2]


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20, range_rows: int = RANGE_ROWS,
          query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank from 1, vec_id, score) of each query's k highest inner products, ties to the smaller id.

    ``queries`` and ``candidates`` hold (id, v array<long>). Candidates with like directions are put together: they
    are sorted by the signs of their leading components and cut into document ranges, whose blocks then have tight
    maxima. Each pair of a query set and a document range is one task that returns k rows a query; those are merged by
    query. A query never meets its own id. Vectors of different lengths don't meet. Equal candidates are ranked by id;
    rows that repeat a candidate's id are separate candidates, rows that repeat a query's id are one query (with the
    smallest of their vectors). No queries or no candidates give no rows. Scores are exact for as long as they fit
    64 bits.
    """
    scratch = Scratch(queries.sparkSession, "topk")
    queries = scratch.write("queries", queries.groupBy("id").agg(F.min("v").alias("v")))
    signs = F.concat(F.lpad(F.size("v").cast("string"), 9, "0"), F.lit(":"), F.concat_ws(
        "", F.transform(F.slice("v", 1, 64), lambda x: F.when(x >= 0, "1").otherwise("0"))))
    n_ranges = max(1, -(-candidates.count() // range_rows))
    n_sets = max(1, -(-queries.count() // query_rows))
    docs = scratch.write("docs", candidates.withColumn("__sign", signs).repartitionByRange(n_ranges, "__sign", "id")
                         .select("id", "v", F.spark_partition_id().alias("part"), "__sign"))
    n_ranges = (docs.agg(F.max("part")).first()[0] or 0) + 1
    asked = queries.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(n_sets)).cast("int"))
    sides = (docs.select("id", "v", F.lit(False).alias("q"), F.col("__sign").alias("sign"), F.col("part").alias("range"),
                         F.explode(F.sequence(F.lit(0), F.lit(n_sets - 1))).alias("set"))
             .unionByName(asked.select("id", "v", F.lit(True).alias("q"), F.lit("").alias("sign"),
                                       F.explode(F.sequence(F.lit(0), F.lit(n_ranges - 1))).alias("range"),
                                       F.col("part").alias("set"))))
    sides = sides.withColumn("dim", F.size("v"))

    def run(group: pa.Table) -> pa.Table:
        asks = group.column("q").to_numpy()
        rows = [np.flatnonzero(asks), np.flatnonzero(~asks)]
        if not len(rows[0]) or not len(rows[1]):
            return pa.table({n: pa.array([], pa.int64()) for n in ("query_id", "vec_id", "score")})
        signs = np.array(group.column("sign").to_pylist(), object)
        ids = group.column("id").to_numpy()
        rows[1] = rows[1][np.lexsort((ids[rows[1]], signs[rows[1]].astype(str)))]
        v = matrix(group.column("v"))
        q, d, s = search(v[rows[0]], ids[rows[0]], v[rows[1]], ids[rows[1]], k)
        return pa.table({"query_id": ids[rows[0]][q], "vec_id": d, "score": s.astype(np.int64)})

    n_units = min(n_ranges * n_sets, 20_000)
    parts = sides.repartition(n_units, "dim", "range", "set").groupBy("dim", "range", "set").applyInArrow(
        run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = parts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
