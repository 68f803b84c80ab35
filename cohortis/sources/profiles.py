"""Schemas, fixed word lists and feature profiles of the cohort study."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortis.functions.encode import age_bucket_names

# They must equal the study's codes for right results.
LESION_SENTINELS = ["NO RECORD", "no record"]
EEG_SENTINELS = [
    "no record",
    "无记录",
    "需查下记录，2018年有入院检查",
    "治疗10个月后脑电图正常",
    "2017年发病，2021年脑电痫样放电",
    "缺",
]
HEAD_FREE_TEXT = "Unconscious after falling at the age of 4"
UNKNOWN_CODE = "9"
DRUGS = ["CBZ", "LEV", "LTG", "OXC", "PHT", "TPM", "VPA"]
HISTORY = ["pretrt_sz_5", "focal", "fam_hx", "febrile", "ci", "birth_t", "head", "drug", "alcohol", "cvd", "psy", "ld"]
IMAGING_CATEGORIES = ["A", "E", "N"]
COHORTS = ["Glasgow", "Perth", "Guangzhou", "Kuala Lumpur", "Chongqing"]
OUTCOME_TEXT = {"Seizure-free": "1", "Not seizure-free": "0"}
OUTCOME_CODE = {"2": "0"}
LABEL = "psuedo_outcome"
AGE_CUTS = (29, 46)
ADULT_AGE = 18

# Null filters of the two cleaning variants.
NULL_FILTERS_CONTINUOUS = ["pretrt_sz_5", "fam_hx", "febrile", "ci", "alcohol", "cvd", "psy", "ld", "focal"]
NULL_FILTERS_BUCKETED = ["ci", "focal"]

RAW_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("pid", "cohort", "sex")]
    + [T.StructField("age_init", T.DoubleType())]
    + [T.StructField(c, T.StringType()) for c in ("lesion", "eeg_cat", *HISTORY, "asm", "outcome_12m")]
)


@dataclass(frozen=True)
class FeatureProfile:
    """One encoding of the model table: which age treatment, which null filters, which columns."""

    name: str
    bucketed_age: bool
    null_filters: tuple[str, ...]

    @property
    def age_columns(self) -> list[str]:
        return age_bucket_names("age_init", AGE_CUTS) if self.bucketed_age else ["age_init"]

    @property
    def features(self) -> list[str]:
        imaging = [f"{c}_{v}" for c in ("lesion", "eeg_cat") for v in IMAGING_CATEGORIES]
        return ["sex", *self.age_columns, *HISTORY, *imaging, *DRUGS]

    @property
    def columns(self) -> list[str]:
        return ["pid", "cohort", *self.features, LABEL]

    @property
    def schema(self) -> T.StructType:
        def kind(c: str) -> T.DataType:
            if c in ("pid", "cohort"):
                return T.StringType()
            return T.DoubleType() if c in DRUGS or c == "age_init" else T.IntegerType()

        return T.StructType([T.StructField(c, kind(c)) for c in self.columns])


BUCKETED = FeatureProfile("bucketed", True, tuple(NULL_FILTERS_BUCKETED))
CONTINUOUS = FeatureProfile("continuous", False, tuple(NULL_FILTERS_CONTINUOUS))


def project_existing(df: DataFrame, names: list[str]) -> DataFrame:
    """Keep the listed columns that exist, in list order."""
    present = set(df.columns)
    return df.select(*[F.col(f"`{c}`") for c in names if c in present])
