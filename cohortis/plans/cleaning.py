"""Scans, projections, filters, encoders, counts, pooling."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from cohortis.functions import encode as enc
from cohortis.operators import clean, stats
from cohortis.plans.registry import query, r, rounded
from cohortis.session import ensure_checkpoint_dir
from cohortis.sources import profiles as P
from cohortis.sources import tables as T
from cohortis.sources import views as V

RAW = [c for c in V.CASE_COLUMNS if c != "row_id"]
WITH = f"with {V.CASES_SQL} "
_in = lambda values: ", ".join(f"'{v}'" for v in values)

LESION_KEEP = f"lesion is not null and lesion not in ({_in(P.LESION_SENTINELS)})"
EEG_KEEP = f"eeg_cat is not null and eeg_cat not in ({_in(P.EEG_SENTINELS)})"
HEAD_KEEP = f"(head is null or head <> '{P.HEAD_FREE_TEXT}')"
CODE_KEEP = f"(pretrt_sz_5 is null or pretrt_sz_5 <> '{P.UNKNOWN_CODE}')"
ADULT = f"age_init >= {P.ADULT_AGE}"
ALLOWED = f"(asm is null or asm in ({_in(P.DRUGS)}))"
OUTCOME = ("cast(case when outcome_12m = 'Seizure-free' then '1' when outcome_12m = 'Not seizure-free' then '0' "
           "when outcome_12m = '2' then '0' else outcome_12m end as int)")


def yn(col: str) -> str:
    return f"case {col} when 'Y' then 1 when 'N' then 0 end"


@query("scan_raw", WITH + f"select {', '.join(RAW)} from cases")
def scan_raw(spark, sf):
    return V.cases(spark, sf).select(*RAW)


def _scratch(spark, name: str) -> str:
    """A fresh folder for a written copy: the shared checkpoint folder, or a private one in local mode."""
    root = ensure_checkpoint_dir(spark)
    return os.path.join(root, f"{name}-{uuid.uuid4().hex}")


@query("csv_roundtrip", f"with {V.CASE_ORDERS_SQL} select case_id, cohort, label, price from case_orders")
def csv_roundtrip(spark, sf):
    df = V.case_orders(spark, sf).select("case_id", "cohort", "label", "price")
    path = _scratch(spark, "csv")
    T.write_table(df, path)
    return T.read_table(spark, path, df.schema)


@query("schema_listing", """
select cast(ordinal_position - 1 as int) as ordinal, column_name as name,
       case data_type when 'BIGINT' then 'bigint' when 'INTEGER' then 'int' when 'VARCHAR' then 'string'
            when 'DOUBLE' then 'double' else 'timestamp_ntz' end as type
from (select row_number() over () as ordinal_position, column_name, column_type as data_type
      from (describe lineitem))""")
def schema_listing(spark, sf):
    return T.schema_listing(V.load(spark, sf, "lineitem"))


def _profile_sql(profile, strict: bool) -> str:
    nulls = " and ".join(f"{c} is not null" for c in profile.null_filters)
    where = " and ".join([LESION_KEEP, EEG_KEEP, CODE_KEEP, HEAD_KEEP, ADULT, nulls])
    age = (
        ["case when age_init <= 29 then 1 else 0 end as age_init_29",
         "case when age_init > 29 and age_init <= 46 then 1 else 0 end as age_init_46",
         'case when age_init <= 46 then 0 else 1 end as "age_init_>46"']
        if profile.bucketed_age
        else [r("(age_init - (select min(age_init) from kept)) / "
                "nullif((select max(age_init) - min(age_init) from kept), 0)") + " as age_init"]
    )
    cols = ["pid", "cohort", "case sex when 'F' then 1 when 'M' then 0 end as sex", *age]
    cols += [f"{yn(c)} as {c}" for c in P.HISTORY]
    cols += [f"case when {c} = '{v}' then 1 else 0 end as {c}_{v}"
             for c in ("lesion", "eeg_cat") for v in P.IMAGING_CATEGORIES]
    cols += [f"case when asm = '{d}' then 1e0 else 0e0 end as \"{d}\"" for d in P.DRUGS]
    cols += [f"{OUTCOME} as {P.LABEL}"]
    return (f"with {V.CASES_SQL}, kept as (select * from cases where {where}) "
            f"select {', '.join(cols)} from kept where {ALLOWED}")


@query("profile_bucketed", _profile_sql(P.BUCKETED, False))
def profile_bucketed(spark, sf):
    # this variant has no null filter for most history columns, so nulls are kept here instead of failing
    return clean.model_table(V.cases(spark, sf), P.BUCKETED, strict=False)


@query("profile_continuous", _profile_sql(P.CONTINUOUS, True))
def profile_continuous(spark, sf):
    return rounded(clean.model_table(V.cases(spark, sf), P.CONTINUOUS), "age_init")


ONE_COHORT = "BUILDING"


def write_by_cohort(spark, sf) -> str:
    """The folder of the model table, one sub-folder a cohort."""
    path = _scratch(spark, "model-table")
    T.write_table(clean.model_table(V.cases(spark, sf), P.CONTINUOUS), path, "parquet", partition_by=["cohort"])
    return path


@query("partitioned_model_table", f"select * from ({_profile_sql(P.CONTINUOUS, True)}) where cohort = '{ONE_COHORT}'")
def partitioned_model_table(spark, sf):
    """One cohort of the written model table; the other cohorts' files are not read."""
    table = T.read_model_table(spark, write_by_cohort(spark, sf), P.CONTINUOUS, "parquet")
    one = table.where(F.col("cohort") == ONE_COHORT)
    return rounded(one.select(*[F.col(f"`{c}`") for c in P.CONTINUOUS.columns]), "age_init")


# ---- filters

@query("drop_sentinel_rows", WITH + f"select row_id, lesion from cases where {LESION_KEEP}")
def drop_sentinel_rows(spark, sf):
    rules = [clean.drop_sentinels("lesion", P.LESION_SENTINELS)]
    return clean.apply_rules(V.cases(spark, sf), rules).select("row_id", "lesion")


@query("drop_sentinel_list", WITH + f"select row_id, eeg_cat from cases where {EEG_KEEP}")
def drop_sentinel_list(spark, sf):
    rules = [clean.drop_sentinels("eeg_cat", P.EEG_SENTINELS)]
    return clean.apply_rules(V.cases(spark, sf), rules).select("row_id", "eeg_cat")


@query("drop_null_subset", WITH + "select row_id, " + ", ".join(P.NULL_FILTERS_CONTINUOUS) + " from cases where "
       + " and ".join(f"{c} is not null" for c in P.NULL_FILTERS_CONTINUOUS))
def drop_null_subset(spark, sf):
    rules = [clean.drop_null(c) for c in P.NULL_FILTERS_CONTINUOUS]
    return clean.apply_rules(V.cases(spark, sf), rules).select("row_id", *P.NULL_FILTERS_CONTINUOUS)


@query("drop_code_value", WITH + f"select row_id, pretrt_sz_5, head from cases where {CODE_KEEP} and {HEAD_KEEP}")
def drop_code_value(spark, sf):
    rules = [clean.drop_value("pretrt_sz_5", P.UNKNOWN_CODE), clean.drop_value("head", P.HEAD_FREE_TEXT)]
    return clean.apply_rules(V.cases(spark, sf), rules).select("row_id", "pretrt_sz_5", "head")


@query("adults_only", WITH + f"select row_id, pid, age_init from cases where {ADULT}")
def adults_only(spark, sf):
    return clean.apply_rules(V.cases(spark, sf), [clean.younger_than("age_init", P.ADULT_AGE)]).select(
        "row_id", "pid", "age_init")


@query("drug_allowlist", WITH + f"select row_id, asm from cases where {ALLOWED}")
def drug_allowlist(spark, sf):
    return clean.apply_rules(V.cases(spark, sf), [clean.not_allowed("asm", P.DRUGS)]).select("row_id", "asm")


@query("cohort_slice", WITH + "select row_id, pid, cohort, outcome_12m from cases where cohort = 'BUILDING'")
def cohort_slice(spark, sf):
    return V.cases(spark, sf).where(F.col("cohort") == "BUILDING").select("row_id", "pid", "cohort", "outcome_12m")


@query("filter_for", WITH + "select row_id, focal from cases where focal = 'N'")
def filter_for(spark, sf):
    return V.cases(spark, sf).where(F.col("focal") == "N").select("row_id", "focal")


@query("project_existing", WITH + "select pid, cohort, sex, asm from cases")
def project_existing(spark, sf):
    return P.project_existing(V.cases(spark, sf), ["pid", "cohort", "no_such_column", "sex", "asm", "CBZ"])


@query("drop_column", WITH + f"select {', '.join(c for c in V.CASE_COLUMNS if c not in ('eeg_cat', 'age_init'))} "
       "from cases")
def drop_column(spark, sf):
    return V.cases(spark, sf).drop("eeg_cat", "age_init")


@query("recode_outcome", WITH + f"select row_id, {OUTCOME} as {P.LABEL} from cases")
def recode_outcome(spark, sf):
    value = enc.recode(enc.recode("outcome_12m", P.OUTCOME_TEXT), P.OUTCOME_CODE).cast("int")
    return V.cases(spark, sf).select("row_id", value.alias("outcome_12m")).withColumnRenamed("outcome_12m", P.LABEL)


_FEATS = ["sex", "focal", "birth_t", "drug"]


@query("assemble_features", WITH + "select row_id, cast(case sex when 'F' then 1 else 0 end as double) as x0, "
       + ", ".join(f"cast({yn(c)} as double) as x{i + 1}" for i, c in enumerate(_FEATS[1:]))
       + f", 4 as width, {OUTCOME} as y from cases")
def assemble_features(spark, sf):
    df = V.cases(spark, sf)
    codes = [enc.binary_map("sex", enc.SEX), *[enc.binary_map(c, enc.YES_NO, strict=False) for c in _FEATS[1:]]]
    label = enc.recode(enc.recode("outcome_12m", P.OUTCOME_TEXT), P.OUTCOME_CODE).cast("int")
    packed = df.select("row_id", F.array(*[c.cast("double") for c in codes]).alias("x"), label.alias("y"))
    return packed.select("row_id", *[F.col("x")[i].alias(f"x{i}") for i in range(4)],
                         F.size("x").alias("width"), "y")


# ---- encoders

@query("binary_map", WITH + "select row_id, case sex when 'F' then 1 else 0 end as sex, "
       + ", ".join(f"{yn(c)} as {c}" for c in ("birth_t", "drug"))
       + f", {yn('focal')} as focal from cases")
def binary_map(spark, sf):
    return V.cases(spark, sf).select(
        "row_id", enc.binary_map("sex", enc.SEX).alias("sex"),
        *[enc.binary_map(c, enc.YES_NO).alias(c) for c in ("birth_t", "drug")],
        enc.binary_map("focal", enc.YES_NO, strict=False).alias("focal"))


_ONE_HOT = [f"case when lesion = '{v}' then 1 else 0 end as lesion_{v}" for v in P.IMAGING_CATEGORIES]


@query("one_hot", WITH + f"select row_id, {', '.join(_ONE_HOT)} from cases")
def one_hot(spark, sf):
    return enc.one_hot(V.cases(spark, sf).select("row_id", "lesion"), "lesion", P.IMAGING_CATEGORIES)


@query("one_hot_drop_first", WITH + f"select row_id, {', '.join(_ONE_HOT[1:])} from cases")
def one_hot_drop_first(spark, sf):
    return enc.one_hot(V.cases(spark, sf).select("row_id", "lesion"), "lesion", P.IMAGING_CATEGORIES, drop_first=True)


@query("age_buckets", WITH + "select row_id, case when age_init <= 29 then 1 else 0 end as age_init_29, "
       "case when age_init > 29 and age_init <= 46 then 1 else 0 end as age_init_46, "
       'case when age_init <= 46 then 0 else 1 end as "age_init_>46", cohort from cases')
def age_buckets(spark, sf):
    return enc.age_buckets(V.cases(spark, sf).select("row_id", "age_init", "cohort"))


@query("treatment_indicators", WITH + "select row_id, "
       + ", ".join(f"case when asm = '{d}' then 1e0 else 0e0 end as \"{d}\"" for d in P.DRUGS) + " from cases")
def treatment_indicators(spark, sf):
    return enc.treatment_indicators(V.cases(spark, sf).select("row_id", "asm"), "asm", P.DRUGS).drop("asm")


@query("minmax_scale", WITH + "select row_id, "
       + r("(age_init - min(age_init) over ()) / nullif(max(age_init) over () - min(age_init) over (), 0)")
       + " as age_init from cases")
def minmax_scale(spark, sf):
    return rounded(enc.min_max(V.cases(spark, sf).select("row_id", "age_init"), "age_init"), "age_init")


@query("zscore_scale", f"with {V.CASE_ORDERS_SQL}, m as (select avg(price) a, stddev_pop(price) s from case_orders) "
       "select case_id, " + r("(price - a) / nullif(s, 0)") + " as price from case_orders, m")
def zscore_scale(spark, sf):
    return rounded(enc.z_score(V.case_orders(spark, sf).select("case_id", "price"), ["price"]), "price")


@query("date_to_epoch", "select event_id, " + r("epoch_us(ts) / 1e6") + " as epoch from events")
def date_to_epoch(spark, sf):
    return rounded(V.load(spark, sf, "events").select("event_id", enc.epoch_seconds("ts").alias("epoch")), "epoch")


# ---- counts

def _rule_sql(rules) -> list[tuple[str, str]]:
    texts = {
        "lesion": f"lesion is null or lesion in ({_in(P.LESION_SENTINELS)})",
        "eeg_cat": f"eeg_cat is null or eeg_cat in ({_in(P.EEG_SENTINELS)})",
        "pretrt_sz_5_value": f"pretrt_sz_5 = '{P.UNKNOWN_CODE}'",
        "head_value": f"head = '{P.HEAD_FREE_TEXT}'",
        "minor": f"age_init is null or age_init < {P.ADULT_AGE}",
        "asm_off_list": f"asm not in ({_in(P.DRUGS)})",
    }
    return [(n, texts.get(n) or f"{n.removesuffix('_null')} is null") for n in rules]


FUNNEL_RULES = ["lesion", "eeg_cat", "pretrt_sz_5_null", "pretrt_sz_5_value", "fam_hx_null", "febrile_null", "ci_null",
                "head_value", "alcohol_null", "cvd_null", "psy_null", "ld_null", "focal_null", "minor", "asm_off_list"]


def _funnel_sql() -> str:
    steps = _rule_sql(FUNNEL_RULES)
    tag = "case " + " ".join(f"when {t} then {i}" for i, (_, t) in enumerate(steps)) + f" else {len(steps)} end"
    names = ", ".join(f"({i}, '{n}')" for i, n in enumerate([*FUNNEL_RULES, "kept"]))
    return (f"with {V.CASES_SQL}, tagged as (select {tag} as step from cases), "
            f"names(step, rule) as (values {names}) "
            f"select cast(step as int) as step, rule, "
            f"cast(case when step < {len(steps)} then (select count(*) from tagged t where t.step = names.step) "
            f"else 0 end as bigint) as dropped, "
            f"cast(case when step < {len(steps)} then (select count(*) from tagged t where t.step > names.step) "
            f"else (select count(*) from tagged t where t.step = names.step) end as bigint) as remaining from names")


@query("cleaning_funnel", _funnel_sql())
def cleaning_funnel(spark, sf):
    rules = clean.study_rules(P.CONTINUOUS) + [clean.not_allowed("asm", P.DRUGS)]
    return clean.funnel(V.cases(spark, sf), rules)


@query("minor_patients", WITH + f"select count(distinct case when age_init < {P.ADULT_AGE} then pid end) as patients "
       "from cases")
def minor_patients(spark, sf):
    return stats.patients_matching(V.cases(spark, sf), F.col("age_init") < P.ADULT_AGE)


@query("patients_per_bucket", WITH + "select bucket, count(distinct pid) as patients from (select pid, "
       "case when age_init <= 29 then 'age_init_29' when age_init <= 46 then 'age_init_46' else 'age_init_>46' end "
       "as bucket from cases) group by bucket")
def patients_per_bucket(spark, sf):
    df = enc.age_buckets(V.cases(spark, sf).select("pid", "age_init"))
    return stats.patients_per_flag(df, enc.age_bucket_names("age_init", P.AGE_CUTS))


@query("distinct_values", WITH + "select distinct asm from cases")
def distinct_values(spark, sf):
    return stats.distinct_values(V.cases(spark, sf), "asm")


@query("label_counts_by_cohort", WITH + f"select cohort, {OUTCOME} as label, count(*) as n from cases group by 1, 2")
def label_counts_by_cohort(spark, sf):
    label = enc.recode(enc.recode("outcome_12m", P.OUTCOME_TEXT), P.OUTCOME_CODE).cast("int")
    return stats.value_counts(V.cases(spark, sf).withColumn("label", label), ["cohort", "label"])


@query("label_counts_rollup", f"with {V.CASE_ORDERS_SQL} select label, cohort, "
       "cast(grouping(cohort) as int) as pooled, count(*) as n from case_orders "
       "group by grouping sets ((label, cohort), (label))")
def label_counts_rollup(spark, sf):
    return stats.label_counts_rollup(V.case_orders(spark, sf))


@query("indicator_sum", WITH + "select cast(sum(case when eeg_cat in ('A', 'E', 'N') then 1 else 0 end) as bigint) "
       f"as total from cases where {EEG_KEEP}")
def indicator_sum(spark, sf):
    df = clean.apply_rules(V.cases(spark, sf), [clean.drop_sentinels("eeg_cat", P.EEG_SENTINELS)])
    df = enc.one_hot(df.select("eeg_cat"), "eeg_cat", P.IMAGING_CATEGORIES)
    return stats.indicator_sum(df, [f"eeg_cat_{v}" for v in P.IMAGING_CATEGORIES])


@query("dataset_sizes", WITH + "select cohort as dataset, count(*) as n from cases group by cohort")
def dataset_sizes(spark, sf):
    return stats.value_counts(V.cases(spark, sf).withColumnRenamed("cohort", "dataset"), ["dataset"])


# ---- set operations

@query("pool_cohorts", WITH + "select row_id, cohort, age_init, cast(null as string) as asm from cases "
       "where cohort = 'BUILDING' union all select row_id, cohort, null, asm from cases where cohort = 'MACHINERY' "
       "union all select row_id, cohort, null, asm from cases where cohort = 'MACHINERY'")
def pool_cohorts(spark, sf):
    df = V.cases(spark, sf)
    a = df.where("cohort = 'BUILDING'").select("row_id", "cohort", "age_init")
    b = df.where("cohort = 'MACHINERY'").select("row_id", "cohort", "asm")
    return stats.pool([a, b, b])


@query("excluded_drugs", WITH + f"select distinct asm from cases where asm is null or asm not in ({_in(P.DRUGS)})")
def excluded_drugs(spark, sf):
    return stats.values_not_in(V.cases(spark, sf), "asm", P.DRUGS)


# ---- commented-out cleaning variants

@query("first_regimen", WITH + "select pid, row_id, asm, age_init from (select *, row_number() over "
       "(partition by pid order by row_id) as rn from cases) where rn = 1")
def first_regimen(spark, sf):
    return clean.first_row_per(V.cases(spark, sf).select("pid", "row_id", "asm", "age_init"), "pid", ["row_id"])


@query("drop_any_null", WITH + f"select {', '.join(V.CASE_COLUMNS)} from cases where "
       + " and ".join(f"{c} is not null" for c in V.CASE_COLUMNS))
def drop_any_null(spark, sf):
    return V.cases(spark, sf).na.drop("any")


@query("fill_null", WITH + "select row_id, coalesce(asm, 'none') as asm, coalesce(" + yn("focal")
       + ", -1) as focal from cases")
def fill_null(spark, sf):
    df = V.cases(spark, sf).select("row_id", "asm", enc.binary_map("focal", enc.YES_NO, strict=False).alias("focal"))
    return df.na.fill({"asm": "none", "focal": -1})


_CORR = {"l_quantity": "l_quantity", "l_discount": "l_discount", "l_tax": "l_tax", "l_extendedprice": "l_extendedprice"}


def _corr_source(spark, sf):
    return V.star(spark, sf).selectExpr(*_CORR, f"{V.LABEL_EXPR} as label")


_CORR_WITH = f"with src as (select {', '.join(_CORR)}, {V.LABEL_EXPR} as label from {V.CASES_FROM}), corrs as (" + \
    " union all ".join(f"select '{c}' as feature, corr({c}, label) as corr from src" for c in _CORR) + ") "


@query("label_correlation", _CORR_WITH + "select feature, " + r("corr") + " as corr from corrs")
def label_correlation(spark, sf):
    return rounded(stats.label_correlation(_corr_source(spark, sf), list(_CORR), "label"), "corr")


@query("low_corr_columns", _CORR_WITH + "select feature, " + r("corr") + " as corr from corrs where abs(corr) < 0.012")
def low_corr_columns(spark, sf):
    return rounded(stats.low_correlation(_corr_source(spark, sf), list(_CORR), "label"), "corr")


@query("corr_matrix", f"with src as (select {', '.join(_CORR)} from lineitem) "
       + " union all ".join(f"select '{a}' as row_feature, '{b}' as col_feature, {r(f'corr({a}, {b})')} as corr from src"
                            for a in _CORR for b in _CORR))
def corr_matrix(spark, sf):
    return rounded(stats.correlation_pairs(V.load(spark, sf, "lineitem"), list(_CORR)), "corr")
