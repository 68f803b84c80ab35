"""Splits, folds, batches, rebalancing, bootstrap."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortis.functions.encode import treatment_indicators
from cohortis.functions.keyed import keyed_hash
from cohortis.operators import bootstrap as bs
from cohortis.operators import neighbours as nn
from cohortis.operators import resample as rs
from cohortis.operators import split as sp
from cohortis.operators import stats
from cohortis.plans.evaluation import auc_sql
from cohortis.plans.registry import hash_sql, query, r, rounded
from cohortis.sources import profiles as P
from cohortis.sources import views as V

WITH = f"with {V.CASE_ORDERS_SQL}"
SEED = 42


def _ranked(purpose: str, by: str = "label") -> str:
    return (f"ranked as (select *, count(*) over (partition by {by}) as n, row_number() over (partition by {by} "
            f"order by {hash_sql(SEED, purpose, 'case_id')}, case_id) as rn from case_orders)")


SPLIT = "case when rn <= ceil(0.2e0 * n) then 'test' else 'train' end"


@query("stratified_split", f"{WITH}, {_ranked('split')} select case_id, label, {SPLIT} as split from ranked")
def stratified_split(spark, sf):
    return sp.stratified_split(V.case_orders(spark, sf).select("case_id", "label"), "label", "case_id")


@query("kfold_assign", f"{WITH}, {_ranked('fold')} select case_id, label, cast("
       + " + ".join(f"(rn > n * {i} // 5)::int" for i in range(1, 5)) + " as int) as fold from ranked")
def kfold_assign(spark, sf):
    return sp.stratified_folds(V.case_orders(spark, sf).select("case_id", "label"), "label", "case_id")


@query("class_counts", f"{WITH}, {_ranked('split')}, s as (select label, {SPLIT} as split from ranked) "
       "select split, cast(sum(label) as bigint) as positives, cast(sum(1 - label) as bigint) as negatives from s group by split")
def class_counts(spark, sf):
    return stats.class_counts(stratified_split(spark, sf), "split")


@query("batch_assign", f"{WITH}, a as (select case_id, (row_number() over (order by case_id) - 1) // 64 as batch_id, "
       f"(row_number() over (order by {hash_sql(SEED, 'batch', 'case_id')}, case_id) - 1) // 64 as shuffled_batch_id "
       "from case_orders) select case_id, cast(batch_id as bigint) as batch_id, "
       "cast(shuffled_batch_id as bigint) as shuffled_batch_id from a")
def batch_assign(spark, sf):
    df = sp.batches(V.case_orders(spark, sf).select("case_id"), "case_id")
    return sp.batches(df, "case_id", seed=SEED, out="shuffled_batch_id")


@query("hashed_batch_assign", f"{WITH} select case_id, {hash_sql(SEED, 'batch', 'case_id')} % 100 as batch_id from case_orders")
def hashed_batch_assign(spark, sf):
    return sp.hashed_batches(V.case_orders(spark, sf).select("case_id"), "case_id", 100)


@query("cohort_roles", f"{WITH} select cohort, case when cohort = 'BUILDING' then 'train' else 'external' end as role, "
       "count(*) as n from case_orders group by cohort")
def cohort_roles(spark, sf):
    return stats.value_counts(sp.cohort_roles(V.case_orders(spark, sf), ["BUILDING"]), ["cohort", "role"])


_INDEX = (f"indexed as (select *, row_number() over (partition by label order by {hash_sql(SEED, 'row', 'case_id')}, "
          "case_id) - 1 as rn from case_orders)")
_COUNTS = ("counts as (select label, n, max(n) over () - n as deficit from "
           "(select label, count(*) as n from case_orders group by label))")


@query("random_oversample", f"{WITH}, {_INDEX}, {_COUNTS}, d as (select label, n, unnest(range(deficit)) as d from counts), "
       f"p as (select label, d, {hash_sql(SEED, 'over', 'label', 'd')} % n as rn from d) "
       "select case_id, label, cohort, cast(0 as bigint) as copy_no from case_orders union all "
       "select i.case_id, i.label, i.cohort, cast(d + 1 as bigint) from p join indexed i on p.label = i.label and p.rn = i.rn")
def random_oversample(spark, sf):
    df = V.case_orders(spark, sf).select("case_id", "label", "cohort")
    return rs.random_oversample(df, "label", "case_id")


@query("weighted_resample", f"{WITH}, {_INDEX}, c as (select count(*) filter (label = 0) as n0, "
       "count(*) filter (label = 1) as n1 from case_orders), "
       "g as (select unnest(range(n0 + n1)) as draw, n0, n1 from c), "
       f"a as (select draw, n0, {hash_sql(SEED, 'weighted', 'draw')} % (n0 + 2 * n1) as pos from g), "
       "p as (select draw, case when pos < n0 then 0 else 1 end as label, "
       "case when pos < n0 then pos else (pos - n0) // 2 end as rn from a) "
       "select draw, i.label, i.case_id from p join indexed i on p.label = i.label and p.rn = i.rn")
def weighted_resample(spark, sf):
    return rs.weighted_resample(V.case_orders(spark, sf).select("case_id", "label"), "label", "case_id", {0: 1, 1: 2})


_NO_DRUG = ", ".join(f'0e0 as "{d}"' for d in P.DRUGS)
_DRUG = ", ".join(f"case when asm = '{d}' then 1e0 else 0e0 end as \"{d}\"" for d in P.DRUGS)
_OUT = "case when outcome_12m = 'Seizure-free' then 1 else 0 end as label"


@query("null_treatment_augment", f"with {V.CASES_SQL} select row_id, {_DRUG}, {_OUT} from cases "
       f"union all select row_id, {_NO_DRUG}, 0 from cases")
def null_treatment_augment(spark, sf):
    df = treatment_indicators(V.cases(spark, sf).select("row_id", "asm", F.expr(_OUT)), "asm", P.DRUGS)
    return rs.null_treatment_augment(df.select("row_id", *P.DRUGS, "label"), P.DRUGS, "label")


# ---- neighbours

VEC_CTE = "v as (select vec_id, cast(label as int) as label, embedding::double[] as x from embeddings)"


def near_cte(k: int, same_class: bool) -> str:
    on = "a.label = b.label and " if same_class else ""
    part = "a.label, a.vec_id" if same_class else "a.vec_id"
    return (f"pairs as (select a.label, a.vec_id, b.vec_id as neighbour, b.label as other, "
            f"round(list_distance(a.x, b.x), 9) as d from v a join v b on {on}a.vec_id <> b.vec_id), "
            f"near as (select * from (select *, row_number() over (partition by vec_id order by d, neighbour) as rank "
            f"from pairs) where rank <= {k})")


@query("smote_neighbours", f"with {VEC_CTE}, {near_cte(5, True)} select label, vec_id, cast(rank as int) as rank, "
       f"neighbour, {r('d')} as distance from near")
def smote_neighbours(spark, sf):
    pairs = nn.nearest_in_group(V.vectors(spark, sf), "label", "vec_id", "x", 5)
    return rounded(pairs.withColumnRenamed("group", "label").withColumnRenamed("id", "vec_id"), "distance")


@query("smote_balance",
       f"with {VEC_CTE}, {near_cte(5, True)}, "
       "counts as (select label, n, max(n) over () - n as deficit from (select label, count(*) as n from v group by label)), "
       "d as (select label, n, unnest(range(deficit)) as d from counts), "
       f"indexed as (select *, row_number() over (partition by label order by {hash_sql(SEED, 'row', 'vec_id')}, vec_id) - 1 as rn from v), "
       f"p as (select label, d, {hash_sql(SEED, 'smote-row', 'label', 'd')} % n as rn, "
       f"{hash_sql(SEED, 'smote-neighbour', 'label', 'd')} % 2147483648 as pick, "
       f"cast({hash_sql(SEED, 'smote-gap', 'label', 'd')} as double) / 1152921504606846976e0 as gap from d), "
       "links as (select vec_id, list(neighbour order by rank) as nb from near group by vec_id), "
       "made as (select i.vec_id, i.label, cast(d + 1 as bigint) as copy_no, nb[(pick % len(nb)) + 1] as neighbour, gap, i.x "
       "from p join indexed i on p.label = i.label and p.rn = i.rn join links l on l.vec_id = i.vec_id), "
       "both_ends as (select m.vec_id, m.label, copy_no, neighbour, gap, unnest(range(len(m.x))) as pos, unnest(m.x) as a, "
       "unnest(o.x) as b from made m join v o on o.vec_id = m.neighbour) "
       "select vec_id, label, cast(0 as bigint) as copy_no, cast(null as bigint) as neighbour, cast(unnest(range(len(x))) as int) as pos, "
       f"{r('unnest(x)')} as value from v union all "
       f"select vec_id, label, copy_no, neighbour, cast(pos as int), {r('a + gap * (b - a)')} from both_ends")
def smote_balance(spark, sf):
    made = rs.smote(V.vectors(spark, sf), "label", "vec_id")
    flat = made.select("vec_id", "label", "copy_no", "neighbour", F.posexplode("x").alias("pos", "value"))
    return rounded(flat, "value")


@query("borderline_seeds", f"with {VEC_CTE}, {near_cte(10, False)}, m as (select vec_id, count(*) filter (other <> 3) as o, "
       "count(*) as n from near where label = 3 group by vec_id) select vec_id, o as other_class, "
       "case when o * 2 >= n and o < n then 1 else 0 end as danger from m")
def borderline_seeds(spark, sf):
    return rs.borderline_seeds(V.vectors(spark, sf), "label", "vec_id", 3)


@query("adasyn_allocation", f"with {VEC_CTE}, {near_cte(5, False)}, m as (select vec_id, count(*) filter (other <> 5) / count(*) as share "
       "from near where label = 5 group by vec_id), g as (select max(n) - max(n) filter (label = 5) as deficit from "
       "(select label, count(*) as n from v group by label)) "
       f"select vec_id, {r('share')} as share, cast(round(share / nullif(sum(share) over (), 0) * deficit) as bigint) as n_synthetic from m, g")
def adasyn_allocation(spark, sf):
    return rounded(rs.adaptive_allocation(V.vectors(spark, sf), "label", "vec_id", 5), "share")


@query("knn_vote", f"with {VEC_CTE}, {near_cte(5, False)}, c as (select vec_id, other, count(*) as votes from near group by 1, 2) "
       "select vec_id, other as predicted, votes from (select *, row_number() over (partition by vec_id order by votes desc, other) "
       "as rn from c) where rn = 1")
def knn_vote(spark, sf):
    df = V.vectors(spark, sf)
    pairs = nn.nearest_in_group(df.withColumn("one", F.lit(0)), "one", "vec_id", "x", 5)
    return nn.vote(pairs, df, "vec_id", "label")


_NEAR_MINORITY = ("mpairs as (select a.vec_id, b.vec_id as neighbour, b.x as ox, a.cell, round(list_distance(a.x, b.x), 9) as d "
                  "from pool a join pool b on a.cell = b.cell and a.vec_id <> b.vec_id), nb as (select vec_id, "
                  "list(neighbour order by rank) as ids, list(ox order by rank) as xs from (select *, row_number() over "
                  "(partition by vec_id order by d, neighbour) as rank from mpairs) where rank <= 5 group by vec_id)")
# ``alloc`` (vec_id, n) and ``pool`` (vec_id, x, cell) are given
_MADE = (f"{_NEAR_MINORITY}, picks as (select vec_id, unnest(range(n)) as d from alloc where n > 0), "
         f"chosen as (select p.vec_id, d, o.x, ids, xs, ({hash_sql(SEED, 'smote-neighbour', 'p.vec_id', 'd')} % 2147483648) % len(ids) + 1 as spot, "
         f"cast({hash_sql(SEED, 'smote-gap', 'p.vec_id', 'd')} as double) / 1152921504606846976e0 as gap "
         "from picks p join nb using (vec_id) join pool o on o.vec_id = p.vec_id), "
         "flat as (select vec_id, cast(d + 1 as bigint) as copy_no, ids[spot] as neighbour, gap, unnest(range(len(x))) as pos, "
         "unnest(x) as a, unnest(xs[spot]) as b from chosen)")


def _rows_sql(label: int) -> str:
    return ("select vec_id, label, cast(0 as bigint) as copy_no, cast(null as bigint) as neighbour, "
            f"cast(unnest(range(len(x))) as int) as pos, {r('unnest(x)')} as value from v union all "
            f"select vec_id, {label}, copy_no, neighbour, cast(pos as int), {r('a + gap * (b - a)')} from flat")


def _flat(made):
    flat = made.select("vec_id", "label", "copy_no", "neighbour", F.posexplode("x").alias("pos", "value"))
    return rounded(flat, "value")


def _deficit_sql(label: int) -> str:
    return (f"g as (select max(n) - max(n) filter (label = {label}) as deficit from "
            "(select label, count(*) as n from v group by label))")


def _drawn_sql(purpose: str) -> str:
    """``alloc`` from ``seeds`` (cell, vec_id) and ``totals`` (cell, n)."""
    return (f"numbered as (select *, row_number() over (partition by cell order by {hash_sql(SEED, 'row', 'vec_id')}, vec_id) - 1 as rn, "
            "count(*) over (partition by cell) as m from seeds), sizes as (select distinct cell, m from numbered), "
            "spread as (select cell, m, unnest(range(n)) as d from totals join sizes using (cell)), "
            f"met as (select cell, {hash_sql(SEED, purpose, 'cell', 'd')} % m as rn from spread), "
            "alloc as (select vec_id, count(*) as n from met join numbered using (cell, rn) group by vec_id)")


@query("borderline_smote", f"with {VEC_CTE}, {near_cte(10, False)}, mix as (select vec_id, count(*) filter (other <> 3) as o, "
       "count(*) as n from near where label = 3 group by vec_id), seeds as (select 0 as cell, vec_id from mix where o * 2 >= n and o < n), "
       f"{_deficit_sql(3)}, totals as (select 0 as cell, deficit as n from g), {_drawn_sql('borderline-row')}, "
       f"pool as (select vec_id, x, 0 as cell from v where label = 3), {_MADE} {_rows_sql(3)}")
def borderline_smote(spark, sf):
    return _flat(rs.borderline_smote(V.vectors(spark, sf), "label", "vec_id", 3))


@query("adasyn_rows", f"with {VEC_CTE}, {near_cte(5, False)}, mix as (select vec_id, count(*) filter (other <> 5) / count(*) as share "
       f"from near where label = 5 group by vec_id), {_deficit_sql(5)}, alloc as (select vec_id, "
       "cast(round(share / nullif(sum(share) over (), 0) * deficit) as bigint) as n from mix, g), "
       f"pool as (select vec_id, x, 0 as cell from v where label = 5), {_MADE} {_rows_sql(5)}")
def adasyn_rows(spark, sf):
    return _flat(rs.adasyn(V.vectors(spark, sf), "label", "vec_id", 5))


@query("svm_smote_seeds", f"with {VEC_CTE}, {near_cte(10, False)}, mix as (select vec_id, count(*) filter (other <> 2) as other_class, "
       "count(*) as n from near where label = 2 group by vec_id) select vec_id, other_class, "
       "case when other_class * 2 >= n then 1e0 else -0.5e0 end as step from mix join v using (vec_id) where 8 * v.x[1] <= 1 and other_class < n")
def svm_smote_seeds(spark, sf):
    scored = V.vectors(spark, sf).withColumn("margin", F.col("x")[0] * 8)
    return rs.margin_seeds(scored, "label", "vec_id", 2, "margin")


@query("svm_smote")
def svm_smote(spark, sf):
    return _flat(rs.svm_smote(V.vectors(spark, sf), "label", "vec_id", 2))


_CELLS = (f"c as (select *, {hash_sql(SEED, 'cell', 'vec_id')} % 4 as cell from v), {_deficit_sql(4)}, "
          "shape as (select cell, count(*) filter (label = 4) as minority_rows, count(*) filter (label <> 4) as other_rows from c group by cell), "
          "parts as (select cell, unnest(range(len(x))) as i, unnest(x) as value from c where label = 4), "
          "moments as (select cell, i, var_samp(value) as v from parts group by cell, i), "
          "spread_of as (select cell, 2 * sum(v) as d2 from moments group by cell), "
          "kept as (select cell, minority_rows, other_rows, d2 / minority_rows as sparsity from shape join spread_of using (cell) "
          "where minority_rows >= 2 and minority_rows / (minority_rows + other_rows) >= (select sum(minority_rows) / sum(minority_rows + other_rows) from shape)), "
          "cell_totals as (select kept.*, cast(round(sparsity / sum(sparsity) over () * deficit) as bigint) as n from kept, g)")


def _celled(spark, sf):
    return V.vectors(spark, sf).withColumn("cell", keyed_hash(SEED, "cell", "vec_id") % 4)


@query("kmeans_smote_cells", f"with {VEC_CTE}, {_CELLS} select cell, minority_rows, other_rows, {r('sparsity')} as sparsity, "
       "n as n_synthetic from cell_totals")
def kmeans_smote_cells(spark, sf):
    return rounded(rs.cell_allocation(_celled(spark, sf), "label", 4, "cell"), "sparsity")


@query("kmeans_smote_rows", f"with {VEC_CTE}, {_CELLS}, totals as (select cell, n from cell_totals), "
       "pool as (select vec_id, x, cell from c join totals using (cell) where label = 4), seeds as (select cell, vec_id from pool), "
       f"{_drawn_sql('cell-row')}, {_MADE} {_rows_sql(4)}")
def kmeans_smote_rows(spark, sf):
    return _flat(rs.kmeans_smote(_celled(spark, sf), "label", "vec_id", 4, cell="cell"))


@query("kmeans_smote")
def kmeans_smote(spark, sf):
    return _flat(rs.kmeans_smote(V.vectors(spark, sf), "label", "vec_id", 4))


@query("knn_unseen", f"with {VEC_CTE}, h as (select *, {hash_sql(SEED, 'unseen', 'vec_id')} % 4 = 0 as held from v), "
       "pairs as (select a.vec_id, b.vec_id as neighbour, b.label as other, round(list_distance(a.x, b.x), 9) as d "
       "from h a join h b on a.held and not b.held), near as (select * from (select *, row_number() over "
       "(partition by vec_id order by d, neighbour) as rank from pairs) where rank <= 5), "
       "c as (select vec_id, other, count(*) as votes from near group by 1, 2) "
       "select vec_id, other as predicted, votes from (select *, row_number() over (partition by vec_id order by votes desc, other) "
       "as rn from c) where rn = 1")
def knn_unseen(spark, sf):
    """A quarter of the rows, by keyed hash, is held out and classified by the rest."""
    df = V.vectors(spark, sf)
    held = keyed_hash(SEED, "unseen", "vec_id") % 4 == 0
    pairs = nn.nearest_across(df.where(held), df.where(~held), "vec_id", "x", 5)
    return nn.vote(pairs, df, "vec_id", "label")


# ---- bootstrap

REPS = 20
_BOOT = (
    f"with {V.DOCS_SQL}, rows_ as (select *, row_number() over (order by doc_id) - 1 as rn, count(*) over () as n from labelled_docs), "
    f"draws as (select rep, unnest(range(n)) as k, n from range({REPS}) t(rep), (select count(*) as n from labelled_docs)), "
    f"picks as (select rep, {hash_sql(SEED, 'boot', 'rep', 'k')} % n as rn from draws), "
    "picked as (select rep, label, score from picks join rows_ using (rn)), "
    "s as (select rep, count(*) filter (label = 1) as p, count(*) filter (label = 0) as q, "
    "count(*) filter (label = 1 and score >= 0.35e0) as tp, count(*) filter (label = 0 and score >= 0.35e0) as fp "
    f"from picked group by rep), a as ({auc_sql('rep', 'picked')}), "
    "reps as (select cast(rep as int) as rep, auc, (tp + q - fp) / (p + q) as accuracy, (q - fp) / nullif(q, 0) as specificity, "
    "tp / nullif(p, 0) as sensitivity, case when tp + fp > 0 then tp / (tp + fp) else 0e0 end as precision "
    "from s join a using (rep) where p > 0 and q > 0)"
)


def _replicates(spark, sf):
    return bs.exact_replicates(V.labelled_docs(spark, sf), "doc_id", REPS, SEED)


@query("bootstrap_replicates", _BOOT + " select rep, " + ", ".join(f"{r(m)} as {m}" for m in bs.METRICS) + " from reps")
def bootstrap_replicates(spark, sf):
    return rounded(_replicates(spark, sf), *bs.METRICS)


@query("bootstrap_ci", _BOOT + ", long as (" + " union all ".join(
    f"select '{m}' as metric, round({m}, 12) as value from reps" for m in bs.METRICS) + "), packed as (select metric, avg(value) as mean, "
    "median(value) as median, list(value order by value) as v, count(*) as m from long group by metric) "
    f"select metric, {r('mean')} as mean, {r('median')} as median, {r('v[cast(floor(5e-2 * m) as int) + 1]')} as p05, "
    f"{r('v[cast(floor(0.95e0 * m) as int) + 1]')} as p95, cast(m as int) as replicates from packed")
def bootstrap_ci(spark, sf):
    return rounded(bs.intervals(_replicates(spark, sf)), "mean", "median", "p05", "p95")


@query("bootstrap_poisson")
def bootstrap_poisson(spark, sf):
    """1000 replicates for each model and cohort over all predictions."""
    return bs.intervals(bs.poisson_replicates(V.scores(spark, sf)), ["model", "cohort"])
