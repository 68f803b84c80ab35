"""Embedding near-duplicates through randomised-rotation binary codes with correction factors and bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortis.llm.common import Forest, Scratch, components

SEED = 5
PIVOTS = 256  # cells; fitted on a sample of that many distinct vectors, chosen by hash
BLOCK_ROWS = 64_000  # vectors of a block that is compared with another at a time, at most
BLOCK_NUMBERS = 4_000_000  # of a block's vectors: fewer rows a block where vectors are long
BLOCKS, SMALL_BLOCK = 16, 4096  # smaller tables are cut into so many blocks, so that all cores have work
SIGMAS = 5.5  # width of the confidence bound in standard deviations of the estimate
TILE = 512  # rows of a block scanned at a time, at most
HELD_ESTIMATES = 4_000_000  # of pairs that are scanned at a time


def rows_a_block(n: int, width: int, most: int) -> int:
    """Rows of a block of ``n`` vectors of ``width`` numbers: about a BLOCKS-th of them, as far as a task may hold."""
    return min(most, max(SMALL_BLOCK, -(-n // BLOCKS)), max(1, BLOCK_NUMBERS // max(1, width)))


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed sign bits of the rotated unit vectors, correction factors).

    With o' the rotated vector and b its signs over sqrt(d), the factor is <b, o'>, the cosine that the binary code
    keeps. For a unit vector q, <b, q'> / factor estimates <o, q> without bias over rotations.
    """
    turned = units @ rotation(units.shape[1]).T
    factor = np.abs(turned).sum(axis=1) / np.sqrt(units.shape[1])
    return np.packbits(turned > 0, axis=1, bitorder="little"), factor


def error_scale(factor: np.ndarray, dim: int, threshold: float) -> np.ndarray:
    """Standard deviation of the estimate for a pair at or above the threshold, at most.

    The code's part across o is spread evenly over the d - 1 other directions, and q's part across o is at most
    sqrt(1 - threshold^2).
    """
    across = np.sqrt(np.maximum(1 - factor**2, 0)) / np.maximum(factor, 1e-12)
    return across * np.sqrt(max(1 - threshold**2, 0)) / np.sqrt(max(dim - 1, 1))


def linked_pairs(left: dict[str, np.ndarray], right: dict[str, np.ndarray] | None, threshold: float,
                 sigmas: float = SIGMAS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of linked rows of two blocks (of one block, i < j, if ``right`` is None).

    The codes of the left block estimate all inner products with the rotated right block. A pair whose upper
    confidence bound lies below the threshold is passed over; every other pair is recomputed from the full vectors in
    double precision, so no pair below the threshold is linked.
    """
    other = left if right is None else right
    dim = left["v"].shape[1]
    norms = [np.sqrt((b["v"] ** 2).sum(axis=1)) for b in (left, other)]
    turned = ((other["v"] / norms[1][:, None]) @ rotation(dim).T).astype(np.float32)
    bits = np.unpackbits(left["code"], axis=1, count=dim, bitorder="little")
    signs = (bits * np.float32(2) - 1) / np.float32(np.sqrt(dim))
    least = left["factor"] * (threshold - sigmas * error_scale(left["factor"], dim, threshold)) - 1e-4
    tile = max(1, min(TILE, HELD_ESTIMATES // max(1, len(turned))))
    for at in range(0, len(signs), tile):
        estimate = signs[at:at + tile] @ turned.T
        i, j = np.nonzero(estimate >= least[at:at + tile, None])
        i += at
        if right is None:
            keep = i < j
            i, j = i[keep], j[keep]
        for k in range(0, len(i), 1 << 16):
            a, b = i[k:k + (1 << 16)], j[k:k + (1 << 16)]
            cosine = np.einsum("nd,nd->n", left["v"][a], other["v"][b]) / (norms[0][a] * norms[1][b])
            near = cosine >= threshold
            yield a[near], b[near]


def near_vectors(vectors: DataFrame, threshold: float = 0.9, key: str = "vec_id", vector: str = "embedding",
                 pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(key, n_links, component_id, kept) for each row of ``vectors``.

    Rows with one vector are one node (the smallest id) with a weight before anything is compared. Nodes fall into the
    cell of their nearest pivot; pivots are a bounded sample, every vector is indexed. Two cells are compared unless
    the angles between their pivots and the cells' radii prove all their pairs below the threshold. Cells are cut into
    blocks by hash and each pair of blocks is one task: it scans binary codes, recomputes what the bounds leave open,
    and returns the blocks' link counts and a spanning forest of the links, so no pairs leave a task and a large cell
    is spread over many. A vector is shuffled once for each block in its reach, which is what fills the disk where
    nothing can be ruled out: blocks are a sixteenth of the table until they are as large as a task may hold. All links are found, up to the bound's confidence (a link is lost with a chance below 1e-6).

    What is null, zero, empty or holds null or non-finite components links with nothing, and so do vectors of
    different lengths. Rows with a null id are counted as links of their equals and neighbours; their own
    component_id is that of their vector, null and ``kept`` if all their equals lack an id. Repeated rows are separate
    rows. An empty table gives none. The driver holds the pivots, the cells' radii and the cell pairs: at most
    ``pivots`` squared, whatever the number of vectors.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    values = F.transform(F.col(vector), lambda x: x.cast("double"))
    valid = F.coalesce(
        (F.size(vector) > 0) & F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(values, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.when(valid, values).alias("v"))
    groups = rows.filter("v is not null").groupBy("v").agg(F.min("id").alias("low"), F.count("*").alias("weight"))
    groups = scratch.write("groups", groups.withColumn("node", F.monotonically_increasing_id()))
    sample = groups.select("v").orderBy(F.xxhash64("v"), F.size("v")).limit(pivots).collect()
    centres: dict[int, np.ndarray] = {}
    for r in sample:
        unit = np.array(r["v"]) / np.linalg.norm(r["v"])
        centres[len(unit)] = np.vstack([*([centres[len(unit)]] if len(unit) in centres else []), unit])
    first = {dim: sum(len(c) for d, c in centres.items() if d < dim) for dim in centres}

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["node", "low", "weight", "v", "dim", "code", "factor", "cell", "near"]
        for batch in batches:
            offsets = batch.column(3).offsets.to_numpy()
            flat = batch.column(3).values.to_numpy()
            dims = np.diff(offsets)
            for dim in np.unique(dims):
                mine = np.flatnonzero(dims == dim)
                full = flat[offsets[mine][:, None] + np.arange(dim)]
                # Exact scaling by a power of two, so that squares neither overflow nor vanish.
                full = np.ldexp(full, -np.frexp(np.abs(full).max(axis=1, keepdims=True))[1])
                units = full / np.linalg.norm(full, axis=1)[:, None]
                code, factor = encode(units)
                known = centres.get(int(dim))
                cosine = units @ known.T if known is not None else np.ones((len(mine), 1))
                cell = cosine.argmax(axis=1)
                near = cosine[np.arange(len(mine)), cell]
                cell = cell + first[int(dim)] if known is not None else np.full(len(mine), -1 - int(dim))
                pick = pa.array(mine)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i).take(pick) for i in range(3)],
                     pa.array([x.tobytes() for x in full], pa.binary()), pa.array(np.full(len(mine), dim, np.int32)),
                     pa.array([x.tobytes() for x in code], pa.binary()), pa.array(factor),
                     pa.array(cell.astype(np.int32)), pa.array(near)], names=names)

    indexed = scratch.write("indexed", groups.select("node", "low", "weight", "v").mapInArrow(
        index, "node long, low long, weight long, v binary, dim int, code binary, factor double, cell int, near double"))
    stats = indexed.groupBy("cell", "dim").agg(F.count("*").alias("n"), F.min("near").alias("near")).collect()
    slack = np.arccos(threshold) + 1e-6
    block_rows = rows_a_block(sum(r["n"] for r in stats), max((r["dim"] for r in stats), default=1), block_rows)
    partners: dict[int, list[int]] = {r["cell"]: [] for r in stats}
    blocks = {r["cell"]: max(1, -(-r["n"] // block_rows)) for r in stats}
    by_dim: dict[int, list] = {}
    for r in stats:
        by_dim.setdefault(r["dim"], []).append(r)
    for dim, cells in by_dim.items():
        if dim not in centres:
            for r in cells:
                partners[r["cell"]].append(r["cell"])
            continue
        cosines = np.clip(centres[dim] @ centres[dim].T, -1, 1)
        radius = {r["cell"]: np.arccos(np.clip(r["near"], -1, 1)) for r in cells}
        for x in radius:
            for y in radius:
                apart = np.arccos(cosines[x - first[dim], y - first[dim]]) if x != y else 0.0
                if apart - radius[x] - radius[y] <= slack:
                    partners[x].append(y)
    # Small cells share blocks: a block is a slot of cells in their order, or one hash part of a large cell.
    slots, slot_of, used = [], {}, 0
    for r in sorted(stats, key=lambda r: (r["dim"], r["cell"])):
        alone = r["n"] > block_rows // 2
        if not slots or alone or used + r["n"] > block_rows or slots[-1][0] != r["dim"] or slots[-1][1] > 1:
            slots.append((r["dim"], blocks[r["cell"]] if alone else 1))
            used = 0
        slot_of[r["cell"]] = len(slots) - 1
        used += r["n"]
    reach: dict[int, set[int]] = {}
    for x, others in partners.items():
        reach.setdefault(slot_of[x], set()).update(slot_of[y] for y in others)
    base = np.concatenate([[0], np.cumsum([n for _, n in slots])]).tolist()
    # One row a cell with a range of blocks for each slot in reach: at most ``pivots`` squared ranges in all.
    table = spark.createDataFrame(
        [(c, base[s], slots[s][1], [(base[o], base[o + 1] - 1) for o in sorted(reach[s])]) for c, s in slot_of.items()],
        "cell int, first int, parts int, others array<struct<lo:int,hi:int>>")
    others = F.flatten(F.transform("others", lambda o: F.sequence(o["lo"], o["hi"])))
    placed = (indexed.join(F.broadcast(table), "cell")
              .withColumn("block", (F.col("first") + F.pmod(F.xxhash64("node"), F.col("parts"))).cast("int")))
    units = placed.select("node", "weight", "v", "code", "factor", "block", F.explode(others).alias("other"))
    units = units.select("*", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    n_units = max(1, sum(slots[s][1] * slots[o][1] for s in reach for o in reach[s]))

    def compare(key_: tuple, batch: pa.Table) -> pa.Table:
        x, y = (k.as_py() for k in key_)
        nodes, weights, block, factor = (batch.column(n).to_numpy() for n in ("node", "weight", "block", "factor"))
        dim = len(batch.column("v")[0].as_py()) // 8
        full = np.frombuffer(b"".join(batch.column("v").to_pylist()), np.float64).reshape(-1, dim)
        code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(nodes), -1)
        sides = [np.flatnonzero(block == b) for b in ((x,) if x == y else (x, y))]
        parts = [{"v": full[s], "code": code[s], "factor": factor[s]} for s in sides]
        if any(len(s) == 0 for s in sides):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        counts, forest = np.zeros(len(nodes)), Forest(len(nodes))
        for i, j in linked_pairs(parts[0], parts[1] if len(parts) > 1 else None, threshold):
            i, j = sides[0][i], sides[-1][j]
            counts += np.bincount(i, weights[j], len(nodes)) + np.bincount(j, weights[i], len(nodes))
            forest.add(i, j)
        found = np.flatnonzero(counts)
        a, b = np.array(forest.links, np.int64).reshape(-1, 2).T
        return pa.table({"a": np.concatenate([nodes[found], nodes[a]]),
                         "b": np.concatenate([np.full(len(found), -1, np.int64), nodes[b]]),
                         "n": np.concatenate([counts[found].astype(np.int64), np.zeros(len(a), np.int64)])})

    results = scratch.write("results", units.repartition(min(n_units, 20_000), "x", "y").groupBy("x", "y").applyInArrow(
        compare, "a long, b long, n long"))
    links = results.filter("b = -1").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    linked = components(scratch, results.filter("b >= 0").select("a", "b"))
    lows = groups.select("node", "low")
    labels = scratch.write("labels", linked.join(lows, "node").groupBy("component").agg(F.min("low").alias("label")))
    nodes = (groups.join(links, "node", "left").join(linked, "node", "left").join(labels, "component", "left")
             .select(F.col("v").alias("w"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"),
                     F.when(F.col("component").isNull(), F.col("low")).otherwise(F.col("label")).alias("label")))
    seen = rows.join(nodes, rows.v == nodes.w, "left")
    component = F.when(F.col("v").isNull(), F.col("id")).otherwise(F.col("label"))
    return seen.select(F.col("id").alias(key), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
                       component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col(key) == F.col("component_id"), F.col("component_id").isNull()))
