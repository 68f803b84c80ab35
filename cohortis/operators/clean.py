"""Row rules, column encoding and the two cleaning variants of the patient table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cohortis.functions.encode import (
    SEX,
    YES_NO,
    age_buckets,
    binary_map,
    min_max,
    one_hot,
    recode,
    treatment_indicators,
)
from cohortis.sources import profiles as P


@dataclass(frozen=True)
class Rule:
    """A row rule: rows where ``drop_when`` is true leave; null counts as not true.

    ``keep_when`` states the same from the other side in plain comparisons,
    which the file source can use to skip row groups.
    """

    name: str
    drop_when: Column
    keep_when: Column | None = None


def keep(rule: Rule) -> Column:
    return rule.keep_when if rule.keep_when is not None else ~F.coalesce(rule.drop_when, F.lit(False))


def apply_rules(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """All rules as plain filters: Catalyst merges them and pushes what it can to the scan."""
    for rule in rules:
        df = df.where(keep(rule))
    return df


def drop_sentinels(col: str, values: list[str]) -> Rule:
    c = F.col(col)
    return Rule(col, c.isNull() | c.isin(*values), c.isNotNull() & ~c.isin(*values))


def drop_null(col: str) -> Rule:
    return Rule(f"{col}_null", F.col(col).isNull(), F.col(col).isNotNull())


def drop_value(col: str, value: str) -> Rule:
    c = F.col(col)
    return Rule(f"{col}_value", c == value, c.isNull() | (c != value))


def younger_than(col: str, years: float) -> Rule:
    # an unknown age does not pass a ">=" keep filter either
    c = F.col(col)
    return Rule("minor", c.isNull() | (c < years), c >= years)


def not_allowed(col: str, values: list[str]) -> Rule:
    """Values off the allowlist leave; null stays."""
    c = F.col(col)
    return Rule(f"{col}_off_list", ~c.isin(*values), c.isNull() | c.isin(*values))


def study_rules(profile: P.FeatureProfile, adults_only: bool = True) -> list[Rule]:
    """The cleaning steps of a profile, in study order."""
    rules = [
        drop_sentinels("lesion", P.LESION_SENTINELS),
        drop_sentinels("eeg_cat", P.EEG_SENTINELS),
    ]
    for col in ("pretrt_sz_5", "fam_hx", "febrile", "ci"):
        if col in profile.null_filters:
            rules.append(drop_null(col))
        if col == "pretrt_sz_5":
            rules.append(drop_value(col, P.UNKNOWN_CODE))
    rules.append(drop_value("head", P.HEAD_FREE_TEXT))
    rules += [drop_null(c) for c in ("alcohol", "cvd", "psy", "ld", "focal") if c in profile.null_filters]
    if adults_only:
        rules.append(younger_than("age_init", P.ADULT_AGE))
    return rules


def model_table(
    raw: DataFrame, profile: P.FeatureProfile, adults_only: bool = True, drop_eeg: bool = False, strict: bool = True,
    extra: tuple[str, ...] = (),
) -> DataFrame:
    """Raw patient table to model table: one lazy plan, plus a one-row aggregate for min-max age.

    The age bounds are taken before the drug allowlist applies, as in the study.
    ``extra`` columns (a row key, say) are carried along in front.
    """
    df = apply_rules(raw, study_rules(profile, adults_only))
    df = df.withColumns({
        "sex": binary_map("sex", SEX, strict),
        **{c: binary_map(c, YES_NO, strict) for c in P.HISTORY},
    })
    df = one_hot(df, "lesion", P.IMAGING_CATEGORIES)
    df = df.drop("eeg_cat") if drop_eeg else one_hot(df, "eeg_cat", P.IMAGING_CATEGORIES)
    df = age_buckets(df, "age_init", P.AGE_CUTS) if profile.bucketed_age else min_max(df, "age_init")
    df = apply_rules(df, [not_allowed("asm", P.DRUGS)])
    df = treatment_indicators(df, "asm", P.DRUGS)
    df = df.withColumn("outcome_12m", recode(recode("outcome_12m", P.OUTCOME_TEXT), P.OUTCOME_CODE).cast("int"))
    df = df.withColumnRenamed("outcome_12m", P.LABEL)
    return P.project_existing(df, [*extra, *profile.columns])


def funnel(raw: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rows dropped by and left after each rule, from one pass over the data.

    Each row is tagged with the first rule that drops it; counts per tag are
    then accumulated over the (short, fixed) rule list.
    """
    step = None
    for i, rule in enumerate(rules):
        test = F.coalesce(rule.drop_when, F.lit(False))
        step = F.when(test, i) if step is None else step.when(test, i)
    counts = raw.groupBy(step.otherwise(len(rules)).alias("step")).agg(F.count(F.lit(1)).alias("n"))
    names = raw.sparkSession.createDataFrame(
        [(i, r.name) for i, r in enumerate(rules)] + [(len(rules), "kept")], "step int, rule string"
    )
    # one row per rule: both windows below run over the rule list, never over data rows
    joined = F.broadcast(names).join(counts, "step", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    after = W.partitionBy(F.lit(1)).orderBy(F.desc("step")).rowsBetween(W.unboundedPreceding, -1)
    return joined.where(F.col("step") <= len(rules)).select(
        "step", "rule",
        F.when(F.col("step") < len(rules), F.col("n")).otherwise(0).alias("dropped"),
        F.when(F.col("step") < len(rules), F.coalesce(F.sum("n").over(after), F.lit(0)))
        .otherwise(F.col("n")).alias("remaining"),
    )


def first_row_per(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """First row of each key in a stated order.

    A minimum over a struct combines on the map side, so a hot key costs one
    row per task rather than a sort of its whole group.
    """
    rest = [c for c in df.columns if c not in order]
    packed = F.struct(*[F.col(f"`{c}`") for c in order], *[F.col(f"`{c}`") for c in rest])
    best = df.groupBy(F.col(f"`{key}`").alias("__key")).agg(
        F.min_by(packed, F.struct(*[F.col(f"`{c}`") for c in order])).alias("__row")
    )
    return best.select(*[F.col(f"__row.`{c}`").alias(c) for c in df.columns])
