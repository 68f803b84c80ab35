"""Class rebalancing: random oversampling, SMOTE, weighted draws, augmentation.

All draws are keyed hashes. Rows are found by their dense number inside the
class, so a draw is an equi-join on (label, row number): evenly spread however
large one class is.
"""

from __future__ import annotations

from pyspark.ml.classification import LinearSVC
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cohortis.functions.keyed import keyed_index, keyed_uniform
from cohortis.operators.neighbours import nearest_in_group
from cohortis.operators.ranking import expand_counts, row_numbers
from cohortis.session import join_on, reliable_checkpoint, small_side


def class_deficits(df: DataFrame, label: str) -> DataFrame:
    """(label, n, deficit): rows of each class and how many it lacks to the largest."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    # one row per class, so this window never sees data rows
    return counts.withColumn("__deficit", F.max("__n").over(W.partitionBy(F.lit(1))) - F.col("__n"))


def random_oversample(df: DataFrame, label: str, key: str, seed: int = 42, copy: str = "copy_no") -> DataFrame:
    """Draw with replacement until every class has as many rows as the largest.

    Original rows have copy number 0, drawn copies 1, 2, ... Only classes that lack rows are
    numbered and shuffled; the largest class passes through.
    """
    short = class_deficits(df, label).where("__deficit > 0")
    names = small_side(short.select(F.col(label).alias("__l")))
    minority = df.join(names, F.col(label).eqNullSafe(F.col("__l")), "left_semi")
    draws = expand_counts(short, "__deficit", "__draw")
    draws = draws.select(
        label, (F.col("__draw") + 1).alias(copy), keyed_index(F.col("__n"), seed, "over", label, "__draw").alias("__row")
    )
    rows = row_numbers(minority, [label], key, seed, "row", "__row")
    copies = join_on(draws, rows, [label, "__row"]).drop("__row")
    return df.withColumn(copy, F.lit(0).cast("bigint")).unionByName(copies)


def weighted_resample(
    df: DataFrame, label: str, key: str, weights: dict[int, int], n_draws: int | None = None, seed: int = 42
) -> DataFrame:
    """``n_draws`` draws with replacement (default: as many as rows), integer weight per class.

    The line [0, sum of weights) is laid out class by class (at most one segment per listed weight),
    so a draw's class and row number follow by arithmetic.
    """
    classes = sorted(weights)
    present = df.where(F.col(label).isin(*classes))
    counts = {row[label]: row["n"] for row in present.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    segments, start = [], 0
    for c in classes:
        size = counts.get(c, 0) * weights[c]
        segments.append((c, start, start + size))
        start += size
    total = n_draws if n_draws is not None else sum(counts.values())
    draws = df.sparkSession.range(total).select(
        F.col("id").alias("draw"), keyed_index(F.lit(max(start, 1)), seed, "weighted", "id").alias("__at")
    )
    which = row = None
    for c, lo, hi in segments:
        inside = F.col("__at") < hi
        number = F.floor((F.col("__at") - lo) / weights[c])
        which = F.when(inside, c) if which is None else which.when(inside, c)
        row = F.when(inside, number) if row is None else row.when(inside, number)
    draws = draws.select("draw", which.cast(df.schema[label].dataType).alias(label), row.alias("__row"))
    rows = row_numbers(present, [label], key, seed, "row", "__row")
    return join_on(draws, rows, [label, "__row"]).drop("__row")


def smote(
    df: DataFrame, label: str, key: str, vector: str = "x", k: int = 5, seed: int = 42, copy: str = "copy_no"
) -> DataFrame:
    """Synthetic minority rows x + u * (neighbour - x) until all classes match the largest.

    Neighbours are the exact k nearest rows of the same class (all there are,
    when fewer). 0/1 columns are interpolated like any other.
    """
    base = df.select(key, label, vector)
    deficits = class_deficits(base, label)
    short = deficits.where("__deficit > 0")
    names = small_side(short.select(F.col(label).alias("__l")))
    minority = base.join(names, F.col(label).eqNullSafe(F.col("__l")), "left_semi")
    pairs = nearest_in_group(minority, label, key, vector, k)
    links = pairs.groupBy("group", "id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "neighbour"))), lambda s: s["neighbour"]).alias("__nb")
    ).withColumnRenamed("group", label).withColumnRenamed("id", key)
    rows = row_numbers(minority, [label], key, seed, "row", "__row")
    rows = join_on(rows, links, [label, key])
    draws = expand_counts(short, "__deficit", "__draw").select(
        label, "__draw", keyed_index(F.col("__n"), seed, "smote-row", label, "__draw").alias("__row"),
        keyed_index(F.lit(2**31), seed, "smote-neighbour", label, "__draw").alias("__pick"),
        keyed_uniform(seed, "smote-gap", label, "__draw").alias("gap"),
    )
    picked = join_on(draws, rows, [label, "__row"])
    picked = picked.withColumn("__other", F.element_at("__nb", (F.pmod("__pick", F.size("__nb")) + 1).cast("int")))
    other = minority.select(F.col(label).alias("__ol"), F.col(key).alias("__ok"), F.col(vector).alias("__ox"))
    joined = picked.join(other, (F.col(label).eqNullSafe(F.col("__ol"))) & (F.col("__other") == F.col("__ok")))
    made = joined.select(
        F.col(key), F.col(label), (F.col("__draw") + 1).alias(copy), F.col("__other").alias("neighbour"), "gap",
        F.transform(F.arrays_zip(F.col(vector).alias("a"), F.col("__ox").alias("b")),
                    lambda s: s["a"] + F.col("gap") * (s["b"] - s["a"])).alias(vector),
    )
    original = base.withColumns({
        copy: F.lit(0).cast("bigint"), "neighbour": F.lit(None).cast(df.schema[key].dataType),
        "gap": F.lit(None).cast("double"),
    })
    return original.unionByName(made)


def _class_mix(df: DataFrame, label: str, key: str, minority, vector: str, m: int) -> DataFrame:
    """(id, other_class, neighbours) of each minority row over its m nearest rows of any class."""
    everyone = df.select(F.lit(0).alias("__one"), key, vector)
    pairs = nearest_in_group(everyone, "__one", key, vector, m, queries=df.where(F.col(label) == minority).select(key))
    others = df.select(F.col(key).alias("neighbour"), F.col(label).alias("__nl"))
    return pairs.join(others, "neighbour").groupBy("id").agg(
        F.count(F.when(F.col("__nl") != minority, 1)).alias("other_class"), F.count(F.lit(1)).alias("neighbours")
    )


def borderline_seeds(
    df: DataFrame, label: str, key: str, minority, vector: str = "x", m: int = 10
) -> DataFrame:
    """Minority rows with at least half, but not all, of their m nearest rows in other classes."""
    mix = _class_mix(df, label, key, minority, vector, m)
    danger = (F.col("other_class") * 2 >= F.col("neighbours")) & (F.col("other_class") < F.col("neighbours"))
    return mix.select(F.col("id").alias(key), "other_class", danger.cast("int").alias("danger"))


def adaptive_allocation(
    df: DataFrame, label: str, key: str, minority, vector: str = "x", k: int = 5
) -> DataFrame:
    """How many synthetic rows each minority row seeds: in proportion to its share of other-class neighbours."""
    mix = _class_mix(df, label, key, minority, vector, k).withColumn("share", F.col("other_class") / F.col("neighbours"))
    deficit = class_deficits(df, label).where(F.col(label) == minority).select("__deficit").scalar()
    total = mix.agg(F.sum("share").alias("s")).scalar()
    return mix.select(F.col("id").alias(key), "share",
                      F.round(F.col("share") / F.nullif(total, F.lit(0.0)) * deficit).cast("bigint").alias("n_synthetic"))


def drawn_allocation(seeds: DataFrame, totals: DataFrame, group: str, key: str, purpose: str, seed: int = 42) -> DataFrame:
    """(key, n_synthetic) of the seeds drawn: ``totals`` (group, n_synthetic) draws with replacement among a group's seeds.

    ``seeds`` has group and a unique key. Seeds that no draw meets are left out, as are groups without seeds.
    """
    rows = row_numbers(seeds.select(group, key), [group], key, seed, "row", "__row")
    sizes = seeds.groupBy(group).agg(F.count(F.lit(1)).alias("__m"))
    draws = expand_counts(join_on(totals.select(group, "n_synthetic"), sizes, [group]), "n_synthetic", "__draw", by=(group,))
    picks = draws.select(group, keyed_index(F.col("__m"), seed, purpose, group, "__draw").alias("__row"))
    met = picks.groupBy(group, "__row").agg(F.count(F.lit(1)).alias("n_synthetic"))
    return join_on(met, rows, [group, "__row"]).select(key, "n_synthetic")


def interpolated(
    pool: DataFrame, group: str, key: str, allocation: DataFrame, vector: str = "x", k: int = 5, seed: int = 42,
    copy: str = "copy_no",
) -> DataFrame:
    """The synthetic rows of ``allocation``: x + step * gap * (neighbour - x), 0 <= gap < 1.

    ``pool`` holds the class to grow; a neighbour is one of the k nearest pool rows of the seed's own group.
    ``allocation`` has a seed's key, its number of rows n_synthetic and, where wanted, ``step`` (1 without it; a
    negative one leads away from the neighbour). A seed's neighbours are put into its row before it is repeated, so no
    join meets the repeated rows and a seed that holds the whole allocation is spread like any other. Seeds without a
    neighbour make no rows. Returns key, group, copy (from 1), neighbour, gap and vector.
    """
    step = F.col("step") if "step" in allocation.columns else F.lit(1.0)
    wanted = allocation.where("n_synthetic > 0").select(key, "n_synthetic", step.cast("double").alias("__step"))
    pairs = nearest_in_group(pool, group, key, vector, k, wanted)
    other = pool.select(F.col(key).alias("neighbour"), F.col(vector).alias("__ox"))
    links = pairs.join(other, "neighbour").groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "neighbour", "__ox"))).alias("__nb"))  # k at most
    seeds = pool.select(key, group, vector).join(wanted, key).join(links.withColumnRenamed("id", key), key)
    drawn = expand_counts(seeds, "n_synthetic", "__draw", by=(key,)).withColumns({
        copy: F.col("__draw") + 1,
        "gap": keyed_uniform(seed, "smote-gap", key, "__draw"),
        "__near": F.element_at("__nb", (F.pmod(keyed_index(F.lit(2**31), seed, "smote-neighbour", key, "__draw"),
                                               F.size("__nb")) + 1).cast("int")),
    })
    return drawn.select(
        key, group, copy, F.col("__near.neighbour").alias("neighbour"), "gap",
        F.zip_with(vector, "__near.__ox", lambda a, b: a + F.col("__step") * F.col("gap") * (b - a)).alias(vector))


def _with_made(df: DataFrame, label: str, key: str, minority, vector: str, made: DataFrame, copy: str) -> DataFrame:
    original = df.select(key, label, vector).withColumns({
        copy: F.lit(0).cast("bigint"), "neighbour": F.lit(None).cast(df.schema[key].dataType),
        "gap": F.lit(None).cast("double")})
    return original.unionByName(made.withColumn(label, F.lit(minority).cast(df.schema[label].dataType)).select(*original.columns))


def _one_group(df: DataFrame, label: str, key: str, minority, vector: str) -> DataFrame:
    return df.where(F.col(label) == minority).select(F.lit(0).alias("__g"), key, vector)


def _deficit(df: DataFrame, label: str, minority) -> DataFrame:
    """(__g, n_synthetic): the one row of a class' deficit; none if the class has no rows."""
    return class_deficits(df, label).where(F.col(label) == minority).select(
        F.lit(0).alias("__g"), F.col("__deficit").alias("n_synthetic"))


def borderline_smote(
    df: DataFrame, label: str, key: str, minority, vector: str = "x", k: int = 5, m: int = 10, seed: int = 42,
    copy: str = "copy_no",
) -> DataFrame:
    """``df`` and synthetic rows of class ``minority``, seeded at its borderline rows alone, up to the largest class.

    Seeds are drawn with replacement among the rows in danger (``borderline_seeds``); neighbours are of the class. No
    row is made if none is in danger.
    """
    danger = borderline_seeds(df, label, key, minority, vector, m).where("danger = 1").select(F.lit(0).alias("__g"), key)
    allocation = drawn_allocation(danger, _deficit(df, label, minority), "__g", key, "borderline-row", seed)
    made = interpolated(_one_group(df, label, key, minority, vector), "__g", key, allocation, vector, k, seed, copy)
    return _with_made(df, label, key, minority, vector, made, copy)


def adasyn(
    df: DataFrame, label: str, key: str, minority, vector: str = "x", k: int = 5, seed: int = 42, copy: str = "copy_no",
) -> DataFrame:
    """``df`` and synthetic rows of class ``minority``, each row's number by ``adaptive_allocation``.

    Neighbours that count towards the allocation are of any class, those interpolated with of the class alone. The
    numbers are rounded row by row, so the class may end a few rows off the largest.
    """
    allocation = adaptive_allocation(df, label, key, minority, vector, k).drop("share")
    made = interpolated(_one_group(df, label, key, minority, vector), "__g", key, allocation, vector, k, seed, copy)
    return _with_made(df, label, key, minority, vector, made, copy)


def margin_seeds(
    df: DataFrame, label: str, key: str, minority, margin: str, vector: str = "x", m: int = 10, out_step: float = 0.5
) -> DataFrame:
    """(key, other_class, step): rows of class ``minority`` on or inside the margin, less the noise.

    ``margin`` is the decision value of a two-class machine, positive for ``minority``; rows of it with a value of 1 or
    less are the support vectors of that side. One whose m nearest rows are all of other classes is noise. ``step`` is 1
    (interpolate) where at least half of them are, else ``-out_step``: among its own kind a row is moved away from its
    neighbour, towards the border. Rows with a null margin are no seeds.
    """
    support = df.where(F.col(margin) <= 1).select(key)
    mix = _class_mix(df, label, key, minority, vector, m).withColumnRenamed("id", key).join(support, key)
    step = F.when(F.col("other_class") * 2 >= F.col("neighbours"), 1.0).otherwise(-float(out_step))
    return mix.where("other_class < neighbours").select(key, "other_class", step.alias("step"))


def svm_margins(df: DataFrame, label: str, minority, vector: str = "x", max_iter: int = 50, reg: float = 0.01) -> DataFrame:
    """``df`` with ``margin``: the decision value of a linear machine fitted to tell ``minority`` from the rest."""
    data = df.withColumns({"__y": (F.col(label) == minority).cast("double"), "__features": array_to_vector(vector)})
    machine = LinearSVC(labelCol="__y", featuresCol="__features", maxIter=max_iter, regParam=reg).fit(data)
    weights, bias = F.array(*[F.lit(float(w)) for w in machine.coefficients]), float(machine.intercept)
    product = F.zip_with(vector, weights, lambda a, b: a * b)
    return df.withColumn("margin", F.aggregate(product, F.lit(bias), lambda s, v: s + v))


def svm_smote(
    df: DataFrame, label: str, key: str, minority, vector: str = "x", k: int = 5, m: int = 10, out_step: float = 0.5,
    seed: int = 42, copy: str = "copy_no", margin: str | None = None,
) -> DataFrame:
    """``df`` and synthetic rows of class ``minority``, seeded at its support vectors, up to the largest class.

    Without a ``margin`` column a linear machine is fitted (``svm_margins``); see ``margin_seeds`` for the choice of
    seeds and the direction of their rows.
    """
    scored = df if margin is not None else svm_margins(df, label, minority, vector)
    seeds = margin_seeds(scored, label, key, minority, margin or "margin", vector, m, out_step)
    seeds = reliable_checkpoint(seeds.select(F.lit(0).alias("__g"), key, "step"))
    allocation = drawn_allocation(seeds, _deficit(df, label, minority), "__g", key, "svm-row", seed)
    allocation = join_on(allocation, seeds.select(key, "step"), [key])
    made = interpolated(_one_group(df, label, key, minority, vector), "__g", key, allocation, vector, k, seed, copy)
    return _with_made(df, label, key, minority, vector, made, copy)


def cell_allocation(
    df: DataFrame, label: str, minority, cell: str, vector: str = "x", min_share: float | None = None,
    exponent: float = 2.0,
) -> DataFrame:
    """(cell, minority_rows, other_rows, sparsity, n_synthetic) of the cells that get synthetic rows.

    A cell is kept if its share of ``minority`` is at least ``min_share`` (default: the share in the whole table) and it
    holds two or more of them. The class' deficit is divided in proportion to sparsity = distance^exponent / rows, where
    distance is the root mean square over the pairs of the cell's minority rows; that comes from sums of squares, so no
    pairs are formed. Numbers are rounded cell by cell. A cell whose minority rows are all equal gets none.
    """
    own = F.col(label) == minority
    shape = df.groupBy(cell).agg(F.count(F.when(own, 1)).alias("minority_rows"), F.count(F.when(~own, 1)).alias("other_rows"))
    # one row for each cell and component
    parts = df.where(own).select(cell, F.posexplode(vector).alias("__i", "__v"))
    moments = parts.groupBy(cell, "__i").agg(F.var_samp("__v").alias("__var"))
    spread_of = moments.groupBy(cell).agg((F.sum("__var") * 2).alias("__d2"))
    overall = shape.agg(F.sum("minority_rows") / F.sum(F.col("minority_rows") + F.col("other_rows"))).scalar()
    floor = F.lit(float(min_share)) if min_share is not None else overall
    share = F.col("minority_rows") / (F.col("minority_rows") + F.col("other_rows"))
    kept = shape.where((F.col("minority_rows") >= 2) & (share >= floor))
    kept = join_on(kept, spread_of, [cell]).withColumn("sparsity", F.pow("__d2", F.lit(exponent / 2)) / F.col("minority_rows"))
    deficit = _deficit(df, label, minority).select("n_synthetic").scalar()
    everything = kept.agg(F.sum("sparsity")).scalar()
    part = F.col("sparsity") / F.nullif(everything, F.lit(0.0))
    return kept.select(cell, "minority_rows", "other_rows", "sparsity",
                       F.coalesce(F.round(part * deficit), F.lit(0.0)).cast("bigint").alias("n_synthetic"))


def kmeans_smote(
    df: DataFrame, label: str, key: str, minority, vector: str = "x", k: int = 5, cells: int = 8, seed: int = 42,
    copy: str = "copy_no", cell: str | None = None, min_share: float | None = None, exponent: float = 2.0,
) -> DataFrame:
    """``df`` and synthetic rows of class ``minority`` made inside the cells where it is common, sparse cells first.

    Without a ``cell`` column the rows of all classes are put into ``cells`` k-means cells. ``cell_allocation`` says how
    many rows each gets; seeds are drawn among a cell's minority rows and neighbours stay in the cell.
    """
    if cell is None:
        data = df.select(key, label, vector, array_to_vector(vector).alias("__features"))
        fitted = KMeans(k=cells, seed=seed, featuresCol="__features", predictionCol="__cell", maxIter=20).fit(data)
        df, cell = fitted.transform(data).drop("__features"), "__cell"
    placed = reliable_checkpoint(df.select(key, label, vector, cell))
    totals = reliable_checkpoint(cell_allocation(placed, label, minority, cell, vector, min_share, exponent))
    pool = join_on(placed.where(F.col(label) == minority), totals.select(cell), [cell])
    allocation = drawn_allocation(pool, totals, cell, key, "cell-row", seed)
    made = interpolated(pool.select(key, cell, vector), cell, key, allocation, vector, k, seed, copy)
    return _with_made(df, label, key, minority, vector, made, copy)


def null_treatment_augment(df: DataFrame, treatments: list[str], label: str) -> DataFrame:
    """Append a copy of every row with no treatment and a negative label."""
    kinds = dict(df.dtypes)
    copies = df.withColumns({
        **{c: F.lit(0).cast(kinds[c]) for c in treatments}, label: F.lit(0).cast(kinds[label])
    })
    return df.unionByName(copies)
