import pytest
from pyspark.sql import functions as F

from cohortis.functions import encode as enc
from cohortis.operators import clean, stats
from cohortis.sources import profiles as P
from cohortis.sources import tables as T

GOOD = dict(pid="p1", cohort="Perth", sex="F", age_init=30.0, lesion="A", eeg_cat="E", asm="LEV",
            outcome_12m="Seizure-free", **{c: "Y" for c in P.HISTORY})


def raw(spark, *changes):
    return spark.createDataFrame([tuple({**GOOD, **c}.get(f.name) for f in P.RAW_SCHEMA.fields) for c in changes],
                                 P.RAW_SCHEMA)


def ids(df):
    return sorted(r["pid"] for r in df.select("pid").collect())


def test_sentinels_and_nulls_leave(spark):
    df = raw(spark, {}, {"pid": "p2", "lesion": None}, {"pid": "p3", "lesion": "NO RECORD"}, {"pid": "p4", "eeg_cat": "缺"},
             {"pid": "p5", "pretrt_sz_5": "9"}, {"pid": "p6", "head": P.HEAD_FREE_TEXT}, {"pid": "p7", "age_init": 17.0},
             {"pid": "p8", "age_init": None}, {"pid": "p9", "asm": "ZNS"}, {"pid": "pa", "asm": None})
    assert ids(clean.model_table(df, P.CONTINUOUS)) == ["p1", "pa"]


def test_rules_say_the_same_from_both_sides(spark):
    df = raw(spark, {}, *[{"pid": f"q{i}", c: v} for i, (c, v) in enumerate(
        [("lesion", None), ("lesion", "no record"), ("head", None), ("head", P.HEAD_FREE_TEXT), ("age_init", None),
         ("asm", None), ("asm", "X"), ("pretrt_sz_5", None), ("pretrt_sz_5", "9")])])
    for rule in clean.study_rules(P.CONTINUOUS) + [clean.not_allowed("asm", P.DRUGS)]:
        dropped = F.coalesce(rule.drop_when, F.lit(False))
        assert df.where(dropped == F.coalesce(clean.keep(rule), F.lit(False))).count() == 0


def test_null_drug_has_no_indicator(spark):
    row = clean.model_table(raw(spark, {"asm": None}), P.BUCKETED).first()
    assert [row[d] for d in P.DRUGS] == [0.0] * 7


def test_columns_and_types_of_both_profiles(spark):
    for profile, width in ((P.BUCKETED, 29), (P.CONTINUOUS, 27)):
        df = clean.model_table(raw(spark, {}, {"age_init": 50.0}), profile)
        assert df.columns == profile.columns and len(profile.features) == width
        assert [f.dataType for f in df.schema] == [f.dataType for f in profile.schema]


def test_drop_eeg(spark):
    df = clean.model_table(raw(spark, {}), P.BUCKETED, drop_eeg=True)
    assert not [c for c in df.columns if c.startswith("eeg")]


def test_outcome_values(spark):
    df = raw(spark, {"pid": "a"}, {"pid": "b", "outcome_12m": "Not seizure-free"}, {"pid": "c", "outcome_12m": "2"},
             {"pid": "d", "outcome_12m": "1"})
    got = {r["pid"]: r[P.LABEL] for r in clean.model_table(df, P.BUCKETED).collect()}
    assert got == {"a": 1, "b": 0, "c": 0, "d": 1}


def test_strict_map_fails_on_unmapped_and_null(spark):
    for value in ("X", None):
        df = spark.createDataFrame([(value,)], "v string")
        with pytest.raises(Exception, match="unmapped code"):
            df.select(enc.binary_map("v", enc.YES_NO)).collect()
        assert df.select(enc.binary_map("v", enc.YES_NO, strict=False)).first()[0] is None


def test_min_max_bounds_come_before_allowlist(spark):
    df = raw(spark, {"pid": "a", "age_init": 20.0}, {"pid": "b", "age_init": 40.0},
             {"pid": "c", "age_init": 60.0, "asm": "ZNS"})
    got = {r["pid"]: r["age_init"] for r in clean.model_table(df, P.CONTINUOUS).collect()}
    assert got == {"a": 0.0, "b": 0.5}


def test_constant_column_scales_to_null(spark):
    df = spark.createDataFrame([(1.0,), (1.0,)], "v double")
    assert {r[0] for r in enc.min_max(df, "v").collect()} == {None}
    assert {r[0] for r in enc.z_score(df, ["v"]).collect()} == {None}


def test_one_hot_discovers_sorted_categories(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "v string")
    assert enc.one_hot(df, "v").columns == ["v_a", "v_b"]
    assert enc.one_hot(df, "v", drop_first=True).columns == ["v_b"]
    assert sorted(map(tuple, enc.one_hot(df, "v").collect())) == [(0, 0), (0, 1), (1, 0)]
    only = df.where("v = 'a'")
    assert enc.one_hot(only, "v", drop_first=True).columns == []


def test_age_buckets_replace_in_place(spark):
    df = spark.createDataFrame([("x", 29.0, 1), ("y", 46.0, 2), ("z", 47.0, 3)], "k string, age_init double, t int")
    out = enc.age_buckets(df)
    assert out.columns == ["k", "age_init_29", "age_init_46", "age_init_>46", "t"]
    assert [tuple(r)[1:4] for r in out.orderBy("k").collect()] == [(1, 0, 0), (0, 1, 0), (0, 0, 1)]


def test_funnel_sums_and_order(spark):
    df = raw(spark, {}, {"lesion": None}, {"lesion": "A", "eeg_cat": None}, {"age_init": 5.0})
    rows = clean.funnel(df, clean.study_rules(P.CONTINUOUS)).orderBy("step").collect()
    assert rows[0]["dropped"] == 1 and rows[0]["remaining"] == 3
    assert rows[-1]["rule"] == "kept" and rows[-1]["remaining"] == 1
    assert sum(r["dropped"] for r in rows) == 3


def test_first_row_per_key(spark):
    df = spark.createDataFrame([(1, 3, "c"), (1, 2, None), (2, 9, "z")], "k int, o int, v string")
    got = clean.first_row_per(df, "k", ["o"])
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect())) == [(1, 2, None), (2, 9, "z")]


def test_pool_fills_missing_columns_and_keeps_copies(spark):
    a = spark.createDataFrame([(1, "x")], "a int, b string")
    b = spark.createDataFrame([(2,)], "a int")
    assert sorted(map(tuple, stats.pool([a, b, b]).collect())) == [(1, "x"), (2, None), (2, None)]


def test_set_difference_keeps_null(spark):
    df = spark.createDataFrame([("CBZ",), ("ZNS",), (None,), (None,)], "asm string")
    assert {r[0] for r in stats.values_not_in(df, "asm", P.DRUGS).collect()} == {"ZNS", None}


def test_drop_low_correlation(spark):
    df = spark.createDataFrame([(float(i), float(i % 2), i % 2) for i in range(100)], "a double, b double, y int")
    assert stats.drop_low_correlation(df, ["a", "b"], "y", 0.05).columns == ["b", "y"]


def test_correlation_uses_pairs_where_both_are_present(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0), (2.0, None, 1.0), (3.0, 7.0, 1.0), (5.0, 3.0, 1.0)],
                               "a double, b double, c double").repartition(3)
    got = {(r[0], r[1]): r[2] for r in stats.correlation_pairs(df, ["a", "b", "c"]).collect()}
    want = df.agg(F.corr("a", "b")).first()[0]
    assert got["a", "b"] == pytest.approx(want) and got["b", "a"] == pytest.approx(want)
    assert got["a", "a"] == pytest.approx(1.0) and got["c", "a"] is None


def test_model_table_roundtrip(spark, tmp_path):
    df = clean.model_table(raw(spark, {}, {"age_init": 50.0}), P.BUCKETED)
    T.write_table(df, str(tmp_path / "csv"))
    back = T.read_model_table(spark, str(tmp_path / "csv"), P.BUCKETED)
    assert back.columns == df.columns and sorted(back.collect()) == sorted(df.collect())
    T.write_table(df, str(tmp_path / "pq"), "parquet", ["cohort"])
    part = spark.read.parquet(str(tmp_path / "pq")).where("cohort = 'Perth'")
    assert "PartitionFilters: [isnotnull(cohort" in part._jdf.queryExecution().toString()


def test_rules_reach_the_parquet_scan(spark, tmp_path):
    raw(spark, {}).write.parquet(str(tmp_path / "raw"))
    df = T.read_raw(spark, str(tmp_path / "raw"), "parquet")
    plan = clean.apply_rules(df, clean.study_rules(P.CONTINUOUS)).select("pid")._jdf.queryExecution().toString()
    pushed = plan[plan.rindex("PushedFilters"):]
    assert "Not(In(lesion, [NO RECORD,no record]))" in pushed and "IsNotNull(age_init)" in pushed
    assert "asm" not in pushed  # the column is not read for this result
