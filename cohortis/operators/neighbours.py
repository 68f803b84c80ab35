"""Exact k nearest neighbours inside groups, by pivot cells and triangle-inequality bounds.

The method is the published two-round kNN join: points go to the cell of their
nearest pivot; the distances between a query and the pivots bound the distance
to any point of a cell, so most cells are never visited. Points of a large cell are
further hashed into blocks of bounded size, small cells share one, and the queries sent to a block
go in chunks of bounded size, so no task holds more than one block and one chunk. What is shuffled where
the bounds rule out little is a copy of every query for each block and of every block for each chunk: the
larger the blocks, the less.
Copies of one vector are reduced to one query and to the k+1 lowest ids before
any of this: among equal distances the lower id wins, so no other copy can be
among the k nearest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from cohortis.functions.keyed import keyed_hash
from cohortis.session import join_on, reliable_checkpoint

POINTS_PER_CELL = 4_000
MAX_PIVOTS = 2_048
MAX_STATS = 65_536  # (group, cell) statistics held by the driver
BLOCK_ROWS = 64_000  # at most; smaller tables are cut into BLOCKS, so that all cores have work
BLOCK_NUMBERS = 4_000_000  # of a block's vectors: fewer rows a block where vectors are long
BLOCKS, SMALL_BLOCK = 16, 8_000
DIGITS = 9  # distances are compared at this precision, then by id
SLACK = 1e-8  # covers that rounding in the pruning bounds
TILE = 64
HELD_CELLS = 1_000_000  # distances that a task holds at a time while it places or routes rows
ROUTED_ROWS = 8_192  # routed rows that leave a task at a time, each with its vector
PAIRS = T.StructType([T.StructField("query", T.LongType()), T.StructField("neighbour", T.LongType()),
                      T.StructField("distance", T.DoubleType())])


def rows_a_block(n: int, width: int, most: int) -> int:
    """Rows of a block of ``n`` vectors of ``width`` numbers: about a BLOCKS-th of them, as far as a task may hold."""
    return min(most, max(SMALL_BLOCK, -(-n // BLOCKS)), max(1, BLOCK_NUMBERS // max(1, width)))


def _matrix(col: pd.Series) -> np.ndarray:
    return np.stack(col.to_numpy()).astype(float) if len(col) else np.zeros((0, 0))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances by direct differences, in tiles of rows."""
    out = np.empty((len(a), len(b)))
    step = max(1, 2_000_000 // max(1, len(b) * a.shape[1]))
    for i in range(0, len(a), step):
        diff = a[i:i + step, None, :] - b[None, :, :]
        out[i:i + step] = np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))
    return out


def _nearest_pivot(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest pivot, distance to it) of each row, in tiles of rows."""
    cell, radius = np.empty(len(x), np.int32), np.empty(len(x))
    step = max(1, HELD_CELLS // len(pivots))
    for i in range(0, len(x), step):
        d = _distances(x[i:i + step], pivots)
        cell[i:i + step], radius[i:i + step] = d.argmin(1), d.min(1)
    return cell, radius


def _candidates(qx: np.ndarray, px: np.ndarray, norms: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, point) places of all pairs that may be among a query's k nearest.

    Squared distances come from one matrix product; the k-th is widened by what such a product may err and by what
    rounded distances may differ, so no pair is lost. Values that are not finite rule nothing out.
    """
    own = np.einsum("ik,ik->i", qx, qx)
    near = (-2 * qx) @ px.T
    near += norms
    near += own[:, None]
    if len(px) <= k or not np.isfinite(near.sum()):
        return np.nonzero(np.ones(near.shape, bool))
    err = 4 * (px.shape[1] + 4) * np.finfo(float).eps * (own + norms.max())
    kth = np.partition(near, k - 1, axis=1)[:, k - 1]
    limit = (np.sqrt(np.maximum(kth + err, 0)) + 2 * 10.0 ** -DIGITS) ** 2 + err
    return np.divmod(np.flatnonzero(near <= limit[:, None]), len(px))


def _best(query_ids: np.ndarray, qx: np.ndarray, ids: np.ndarray, px: np.ndarray, k: int) -> pd.DataFrame:
    """The k best (rounded distance, id) of each query among the given points, by direct differences."""
    found = []
    norms = np.einsum("ik,ik->i", px, px)
    for i in range(0, len(query_ids), TILE):
        tile = qx[i:i + TILE]
        q, p = _candidates(tile, px, norms, k)
        d = np.empty(len(q))
        step = max(1, 2_000_000 // max(1, px.shape[1]))
        for j in range(0, len(q), step):
            diff = tile[q[j:j + step]] - px[p[j:j + step]]
            d[j:j + step] = np.sqrt(np.einsum("ik,ik->i", diff, diff))
        d = np.round(d, DIGITS)
        order = np.lexsort((ids[p], d, q))
        q, p, d = q[order], p[order], d[order]
        kept = np.arange(len(q)) - np.searchsorted(q, q) < k
        found.append(pd.DataFrame({"query": query_ids[i:i + TILE][q[kept]], "neighbour": ids[p[kept]], "distance": d[kept]}))
    return pd.concat(found) if found else pd.DataFrame({"query": [], "neighbour": [], "distance": []})


def _routes(part: pd.DataFrame, pivots: np.ndarray, here: list[tuple], blocks: np.ndarray, k: int) -> Iterator[pd.DataFrame]:
    """The queries of ``part``, of one group, once for each block that the bounds leave open, other than their own.

    ``here`` has the (number, points, least and greatest radius) of the group's cells and the number of the slot that
    each lies in (its own number, if not given), ``blocks`` the numbers of blocks of these slots. A query goes once to
    a slot, however many of its cells are open. It may go to every block, so rows are put out in pieces of ROUTED_ROWS.
    """
    number = np.array([c[0] for c in here])
    slot = np.array([c[4] if len(c) > 4 else c[0] for c in here])
    count = np.array([c[1] for c in here])
    lo, hi = np.array([c[2] for c in here]), np.array([c[3] for c in here])
    step = max(1, HELD_CELLS // len(here))
    for at in range(0, len(part), step):
        rows = part.iloc[at:at + step]
        d = _distances(_matrix(rows["v"]), pivots[number])
        # k+1 points are certain within the first cells that together hold as many
        reach = d + hi
        order = reach.argsort(1)
        enough = (np.cumsum(count[order], 1) >= k + 1)
        first = np.where(enough.any(1), enough.argmax(1), len(here) - 1)
        certain = np.where(enough.any(1), reach[np.arange(len(d)), order[np.arange(len(d)), first]], np.inf)
        limit = np.minimum(rows["bound"].to_numpy(), certain) + SLACK
        q, c = np.nonzero((d - hi <= limit[:, None]) & (lo - d <= limit[:, None]))
        _, first = np.unique(q * (int(slot.max()) + 1) + slot[c], return_index=True)
        q, c = q[first], c[first]
        ends = np.cumsum(blocks[c])
        for low in range(0, int(ends[-1]) if len(ends) else 0, ROUTED_ROWS):
            spot = np.arange(low, min(low + ROUTED_ROWS, int(ends[-1])))
            pair = np.searchsorted(ends, spot, side="right")
            block = spot - (ends[pair] - blocks[c[pair]])
            source = rows.iloc[q[pair]]
            out = pd.DataFrame({"g": source["g"].to_numpy(), "cell": slot[c[pair]].astype(np.int32),
                                "block": block.astype(np.int32), "query": source["query"].to_numpy(),
                                "v": source["v"].to_numpy()})
            home = (out["cell"].to_numpy() == source["cell"].to_numpy()) & (
                out["block"].to_numpy() == source["block"].to_numpy())
            yield out[~home]


def _visit(asked: DataFrame, blocked: DataFrame, pivots, cells, blocks_of, k: int, block_rows: int) -> DataFrame:
    """Partial answers (k + 1 best) from every block, other than a query's own, that the bounds cannot rule out.

    ``asked`` has g, query, v, the query's own cell and block (-1: none) and ``bound``, a distance within which k + 1
    points are known to lie (infinite: not known). Queries of a group without points get no rows.
    """
    place = [T.StructField("g", blocked.schema["g"].dataType), T.StructField("cell", T.IntegerType()),
             T.StructField("block", T.IntegerType())]
    routed_schema = T.StructType([*place, T.StructField("query", T.LongType()), T.StructField("v", T.ArrayType(T.DoubleType()))])
    counts_schema = T.StructType([*place, T.StructField("n", T.LongType())])

    def route(batches):
        for pdf in batches:
            for g, part in pdf.groupby("g", dropna=False):
                here = cells.get(None if pd.isna(g) else g)
                if here is None:
                    continue
                blocks = np.array([blocks_of[(None if pd.isna(g) else g, c[4])] for c in here])
                yield from _routes(part, pivots, here, blocks, k)

    def count(batches):
        for routes in route(batches):
            yield routes.groupby(["g", "cell", "block"], dropna=False).size().reset_index(name="n")

    # Routes are found twice, to be counted and to be sent: their vectors are written once, by the shuffle to the blocks.
    load = asked.mapInPandas(count, counts_schema).groupBy("g", "cell", "block").agg(
        F.ceil(F.sum("n") / block_rows).cast("int").alias("chunks"))
    load = F.broadcast(reliable_checkpoint(load))  # one row a block
    chunked = join_on(asked.mapInPandas(route, routed_schema), load, ["g", "cell", "block"]).withColumn(
        "chunk", F.pmod(keyed_hash(0, "chunk", "query"), F.col("chunks")).cast("int")).drop("chunks")
    spread = join_on(blocked.drop("ask"), load, ["g", "cell", "block"]).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")

    def across(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query": [], "neighbour": [], "distance": []})
        right = right.sort_values("id")
        return _best(left["query"].to_numpy(), _matrix(left["v"]), right["id"].to_numpy(), _matrix(right["v"]), k + 1)

    where = ["g", "cell", "block", "chunk"]
    return chunked.groupBy(*where).cogroup(spread.groupBy(*where)).applyInPandas(across, PAIRS)


def _index(data: DataFrame, points_per_cell: int, block_rows: int):
    """The points (g, id, v, c, ask) in slots and blocks, the pivots, each group's cells, each slot's blocks, rows a block.

    ``c`` numbers the copies of a vector, 1 first; ``data`` must not be empty. A slot is one large cell, in as many
    blocks as it needs, or several small cells of a group that together fill one block; ``cell`` of the points is
    their slot.
    """
    spark = data.sparkSession
    distinct_n = data.where("c = 1").count()
    n_groups = data.select("g").distinct().count()
    n_pivots = max(1, min(MAX_PIVOTS, MAX_STATS // n_groups, -(-distinct_n // points_per_cell)))
    pivot_rows = (
        data.where("c = 1").orderBy(keyed_hash(0, "pivot", "id"), "id").limit(n_pivots).select("v").collect()
    )
    pivots = np.array([row[0] for row in pivot_rows], dtype=float)
    group_type = data.schema["g"].dataType

    def place(batches):
        for pdf in batches:
            pdf["cell"], pdf["radius"] = _nearest_pivot(_matrix(pdf["v"]), pivots)
            yield pdf

    placed_schema = T.StructType([*data.schema.fields, T.StructField("cell", T.IntegerType()),
                                  T.StructField("radius", T.DoubleType())])
    placed = data.mapInPandas(place, placed_schema)
    stats = placed.groupBy("g", "cell").agg(
        F.count(F.lit(1)).alias("n"), F.min("radius").alias("lo"), F.max("radius").alias("hi")
    ).collect()  # at most MAX_STATS rows
    block_rows = rows_a_block(sum(row["n"] for row in stats), pivots.shape[1], block_rows)
    away = _distances(pivots[:1], pivots)[0]  # cells of one slot are about equally far from one point
    cells, blocks_of, open_slots, slots = {}, {}, {}, 0
    for row in sorted(stats, key=lambda row: (away[row["cell"]], row["cell"])):
        g, n = row["g"], row["n"]
        slot, held = open_slots.get(g, (None, block_rows))
        if held + n > block_rows:
            slot, held, slots = slots, 0, slots + 1
            blocks_of[(g, slot)] = -(-n // block_rows)
        open_slots[g] = (slot, held + n)
        cells.setdefault(g, []).append((row["cell"], n, row["lo"], row["hi"], slot))
    shape = spark.createDataFrame(
        [(g, c[0], c[4], blocks_of[(g, c[4])]) for g, here in cells.items() for c in here],
        T.StructType([T.StructField("g", group_type), T.StructField("cell", T.IntegerType()),
                      T.StructField("slot", T.IntegerType()), T.StructField("blocks", T.IntegerType())]),
    )
    blocked = join_on(placed, F.broadcast(shape), ["g", "cell"]).withColumn(
        "block", F.pmod(keyed_hash(0, "block", "id"), F.col("blocks")).cast("int")
    )
    blocked = reliable_checkpoint(blocked.select("g", F.col("slot").alias("cell"), "block", "id", "v", "ask"))
    return blocked, pivots, cells, blocks_of, block_rows


def nearest_in_group(
    df: DataFrame, group: str, key: str, vector: str, k: int, queries: DataFrame | None = None,
    points_per_cell: int = POINTS_PER_CELL, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(group, id, rank, neighbour, distance): the k nearest other rows of the same group, exact.

    ``key`` must be a unique integer. ``queries`` (a frame with ``key``) restricts the rows asked for.
    """
    spark = df.sparkSession
    points = df.select(F.col(group).alias("g"), F.col(key).cast("bigint").alias("id"),
                       F.col(vector).cast("array<double>").alias("v"))
    # Copies: one query per distinct vector (its lowest id), and the k+1 lowest ids as data.
    copies = W.partitionBy("g", "v").orderBy("id")
    data = points.withColumn("c", F.row_number().over(copies)).where(F.col("c") <= k + 1)
    rows = points
    if queries is not None:
        rows = points.join(queries.select(F.col(key).cast("bigint").alias("id")), "id", "left_semi")
        needed = rows.select("g", "v", F.lit(True).alias("needed")).distinct()
        data = join_on(data, needed, ["g", "v"], "left")
    else:
        data = data.withColumn("needed", F.lit(True))
    data = data.select("g", "id", "v", "c", F.expr("c = 1 and coalesce(needed, false)").alias("ask"))
    data = reliable_checkpoint(data)
    if data.isEmpty():
        return spark.createDataFrame([], "group int, id bigint, rank int, neighbour bigint, distance double")
    blocked, pivots, cells, blocks_of, block_rows = _index(data, points_per_cell, block_rows)

    # Round 1: each block against itself. Gives partial answers and an upper bound for its queries.
    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        asked = pdf[pdf["ask"]]
        return _best(asked["id"].to_numpy(), _matrix(asked["v"]), pdf["id"].to_numpy(), _matrix(pdf["v"]), k + 1)

    own = blocked.groupBy("g", "cell", "block").applyInPandas(within, PAIRS)
    own = reliable_checkpoint(own)
    found = own
    per_group = {}
    for (g, _), n in blocks_of.items():
        per_group[g] = per_group.get(g, 0) + n
    if max(per_group.values()) > 1:
        # Round 2: visit every other block that may hold something nearer than the bound.
        bound = own.groupBy("query").agg(
            F.when(F.count(F.lit(1)) > k, F.max("distance")).otherwise(F.lit(float("inf"))).alias("bound"))
        asked = blocked.where("ask").select("g", "cell", "block", F.col("id").alias("query"), "v").join(bound, "query")
        found = own.unionByName(_visit(asked, blocked, pivots, cells, blocks_of, k, block_rows))
    best = W.partitionBy("query").orderBy("distance", "neighbour")
    merged = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)

    # Back to rows: every copy takes the answers of its vector, without itself.
    lists = merged.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("distance", "neighbour"))).alias("near"))
    vectors = data.where("ask").select("g", "v", F.col("id").alias("query")).join(lists, "query")
    answered = join_on(rows, vectors, ["g", "v"])
    near = F.slice(F.filter("near", lambda s: s["neighbour"] != F.col("id")), 1, k)
    return answered.select(F.col("g").alias("group"), "id", F.posexplode(near).alias("p", "n")).select(
        "group", "id", (F.col("p") + 1).alias("rank"), F.col("n.neighbour").alias("neighbour"),
        F.col("n.distance").alias("distance"))


def nearest_across(
    queries: DataFrame, points: DataFrame, key: str, vector: str, k: int,
    points_per_cell: int = POINTS_PER_CELL, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(id, rank, neighbour, distance): the k nearest rows of ``points`` to each row of ``queries``, exact.

    For rows a model has not seen: the two tables need not share any, and a query is never its own neighbour unless
    ``points`` holds it. Both have ``key``, a unique integer, and ``vector``. Points are indexed as in
    ``nearest_in_group``; equal queries are searched once; every query goes to the blocks its bounds leave open. Rows
    with a null vector take no part; fewer points than k give as many neighbours; no points give no rows.
    """
    spark = queries.sparkSession
    names = [F.lit(0).alias("g"), F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")]
    copies = W.partitionBy("v").orderBy("id")
    data = points.select(*names).where("v is not null").withColumn("c", F.row_number().over(copies)).where(F.col("c") <= k)
    data = reliable_checkpoint(data.withColumn("ask", F.lit(False)))
    rows = queries.select(*names).where("v is not null")
    if data.isEmpty():
        return spark.createDataFrame([], "id bigint, rank int, neighbour bigint, distance double")
    blocked, pivots, cells, blocks_of, block_rows = _index(data, points_per_cell, block_rows)
    heads = reliable_checkpoint(rows.groupBy("g", "v").agg(F.min("id").alias("query")))
    asked = heads.select("g", F.lit(-1).alias("cell"), F.lit(-1).alias("block"), "query", "v",
                         F.lit(float("inf")).alias("bound"))
    found = _visit(asked, blocked, pivots, cells, blocks_of, k, block_rows)
    best = W.partitionBy("query").orderBy("distance", "neighbour")
    merged = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k)
    lists = merged.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("distance", "neighbour"))).alias("near"))
    answered = join_on(rows, heads.join(lists, "query").select("v", "near"), ["v"])
    return answered.select("id", F.posexplode("near").alias("p", "n")).select(
        "id", (F.col("p") + 1).alias("rank"), F.col("n.neighbour").alias("neighbour"), F.col("n.distance").alias("distance"))


def vote(pairs: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """Majority label of each row's neighbours; a tie goes to the lower label."""
    named = pairs.join(labels.select(F.col(key).alias("neighbour"), F.col(label).alias("__l")), "neighbour")
    counts = named.groupBy("id", "__l").agg(F.count(F.lit(1)).alias("votes"))
    best = counts.groupBy("id").agg(F.min_by("__l", F.struct(-F.col("votes"), F.col("__l"))).alias("predicted"),
                                    F.max("votes").alias("votes"))
    return best.withColumnRenamed("id", key)
