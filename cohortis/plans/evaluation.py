"""Threshold, ROC, AUC and loss queries over the prediction table."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortis.operators import evaluate as ev
from cohortis.plans.registry import query, r, rounded
from cohortis.sources import tables as T
from cohortis.sources import views as V

K = "model, cohort"
WITH = f"with {V.SCORES_SQL}"
METRICS = ["sensitivity", "specificity", "accuracy", "weighted_accuracy"]


def counts_sql(by: str, threshold: str, source: str = "scores") -> str:
    return (f"select {by}, count(*) filter (score >= {threshold} and label = 1) as tp, "
            f"count(*) filter (score < {threshold} and label = 1) as fn, "
            f"count(*) filter (score < {threshold} and label = 0) as tn, "
            f"count(*) filter (score >= {threshold} and label = 0) as fp from {source} group by {by}")


SENS = "tp / nullif(tp + fn, 0)"
SPEC = "tn / nullif(tn + fp, 0)"
ACC = "(tp + tn) / nullif(tp + fn + tn + fp, 0)"
WACC = f"0.5e0 * {SPEC} + 0.5e0 * {SENS}"
METRICS_SQL = f"{r(SENS)} as sensitivity, {r(SPEC)} as specificity, {r(ACC)} as accuracy, {r(WACC)} as weighted_accuracy"
SWEEP_CTE = (
    "thresholds as (select cast(i as double) / 20 as threshold from range(21) t(i)), "
    f"sweep_counts as (select {K}, threshold, count(*) filter (score >= threshold and label = 1) as tp, "
    "count(*) filter (score < threshold and label = 1) as fn, count(*) filter (score < threshold and label = 0) as tn, "
    f"count(*) filter (score >= threshold and label = 0) as fp from scores, thresholds group by {K}, threshold), "
    f"sweep as (select *, {WACC} as w from sweep_counts)"
)
CELLS_CTE = (f"cells as (select {K}, score, count(*) filter (label = 1) as pos, count(*) filter (label = 0) as neg "
             f"from scores group by {K}, score)")


def auc_sql(by: str, source: str = "scores") -> str:
    """Mid-rank AUC."""
    return (
        f"select {by}, (sum(midrank) filter (label = 1) - count(*) filter (label = 1) * "
        f"(count(*) filter (label = 1) + 1) / 2e0) / nullif(count(*) filter (label = 1) * "
        f"count(*) filter (label = 0), 0) as auc from (select {by}, label, "
        f"rank() over (partition by {by} order by score) + "
        f"(count(*) over (partition by {by}, score) - 1) / 2e0 as midrank from {source}) group by {by}"
    )


@query("confusion_counts", f"{WITH} {counts_sql(K, '0.5e0')}")
def confusion_counts(spark, sf):
    return ev.confusion_counts(V.scores(spark, sf))


@query("threshold_metrics", f"{WITH}, c as ({counts_sql(K, '0.5e0')}) select {K}, tp, fn, tn, fp, {METRICS_SQL} from c")
def threshold_metrics(spark, sf):
    return rounded(ev.threshold_metrics(V.scores(spark, sf)), *METRICS)


@query("fixed_threshold_report", f"{WITH}, c as ({counts_sql(K, '0.35e0')}) select {K}, {r(ACC)} as accuracy, "
       f"{r(SENS)} as sensitivity, {r(SPEC)} as specificity from c")
def fixed_threshold_report(spark, sf):
    return rounded(ev.fixed_threshold_report(V.scores(spark, sf)), "accuracy", "sensitivity", "specificity")


@query("metric_report", f"{WITH}, c as ({counts_sql(K, '0.5e0')}) select {K}, round({SENS}, 2) as sensitivity, "
       f"round({SPEC}, 2) as specificity, round({ACC}, 2) as accuracy, round({WACC}, 2) as weighted_accuracy from c")
def metric_report(spark, sf):
    metrics = ev.threshold_metrics(V.scores(spark, sf)).select("model", "cohort", *METRICS)
    return T.metric_report(metrics, METRICS)


@query("threshold_sweep", f"{WITH}, {SWEEP_CTE} select {K}, threshold, tp, fn, tn, fp, {METRICS_SQL} from sweep")
def threshold_sweep(spark, sf):
    return rounded(ev.threshold_sweep(V.scores(spark, sf)), *METRICS)


@query("best_threshold", f"{WITH}, {SWEEP_CTE} select {K}, threshold, {r('w')} as weighted_accuracy from "
       f"(select *, row_number() over (partition by {K} order by round(w, 12) desc nulls last, threshold) as rn from sweep) "
       "where rn = 1")
def best_threshold(spark, sf):
    sweep = ev.threshold_sweep(V.scores(spark, sf)).withColumn("weighted_accuracy", F.round("weighted_accuracy", 12))
    best = ev.best_threshold(sweep)
    return rounded(best.select("model", "cohort", "threshold", "weighted_accuracy"), "weighted_accuracy")


@query("threshold_series", f"{WITH}, {SWEEP_CTE} select {K}, threshold, {r('w')} as weighted_accuracy from sweep "
       "where threshold < 0.93e0")
def threshold_series(spark, sf):
    return rounded(ev.threshold_series(ev.threshold_sweep(V.scores(spark, sf))), "weighted_accuracy")


ROC_CTE = (
    f"{CELLS_CTE}, run as (select *, sum(pos) over w as cp, sum(neg) over w as cn, "
    f"sum(pos) over (partition by {K}) as ap, sum(neg) over (partition by {K}) as an, "
    "lead(pos) over w as np, lead(neg) over w as nn, lag(pos) over w as pp from cells "
    f"window w as (partition by {K} order by score desc))"
)


@query("roc_curve", f"{WITH}, {ROC_CTE} select {K}, score as threshold, {r('cn / nullif(an, 0)')} as fpr, "
       f"{r('cp / nullif(ap, 0)')} as tpr from run where pp is null or np is null or np <> pos or nn <> neg "
       f"union all select {K}, cast('infinity' as double), 0e0, 0e0 from run where pp is null")
def roc_curve(spark, sf):
    return rounded(ev.roc_curve(V.scores(spark, sf)), "fpr", "tpr")


@query("auc_trapezoid", f"{WITH}, {ROC_CTE} select {K}, "
       f"{r('sum((neg / nullif(an, 0)) * ((cp + cp - pos) / 2e0 / nullif(ap, 0)))')} as auc from run group by {K}")
def auc_trapezoid(spark, sf):
    return rounded(ev.auc_trapezoid(V.scores(spark, sf)), "auc")


@query("auc_rank_by_cohort", f"{WITH} select {K}, {r('auc')} as auc from ({auc_sql(K)})")
def auc_rank_by_cohort(spark, sf):
    return rounded(ev.auc_rank(V.scores(spark, sf)), "auc")


@query("external_validation", f"{WITH}, c as ({counts_sql(K, '0.5e0')}), a as ({auc_sql(K)}) "
       f"select {K}, tp, fn, tn, fp, {r('auc')} as auc, {METRICS_SQL} from c join a using (model, cohort)")
def external_validation(spark, sf):
    return rounded(ev.external_validation(V.scores(spark, sf)), "auc", *METRICS)


def _log(c: str) -> str:
    return f"case when {c} > 0 then greatest(ln(case when {c} > 0 then {c} else 1 end), -1e2) else -1e2 end"


LOSS = f"-(label * ({_log('score')}) + (1 - label) * ({_log('(1 - score)')}))"


@query("log_loss", f"{WITH} select {K}, {r(f'avg({LOSS})')} as log_loss from scores group by {K}")
def log_loss(spark, sf):
    return rounded(ev.log_loss(V.scores(spark, sf)), "log_loss")


# Documents stand for the scored set where a numeric row id is wanted: batches of 64 by id.
@query("log_loss_batched", f"with {V.CASE_ORDERS_SQL}, s as (select cohort, label, "
       "cast((case_id * 37) % 101 as double) / 1e2 as score, case_id // 64 as batch_id from case_orders), "
       f"b as (select cohort, batch_id, avg({LOSS}) as l from s group by cohort, batch_id) "
       f"select cohort, {r('avg(l)')} as log_loss from b group by cohort")
def log_loss_batched(spark, sf):
    df = V.case_orders(spark, sf).select(
        "cohort", "label", ((F.col("case_id") * 37 % 101).cast("double") / 1e2).alias("score"),
        F.floor(F.col("case_id") / 64).alias("batch_id"))
    return rounded(ev.log_loss_batched(df, ["cohort"]), "log_loss")


@query("weighted_log_loss", f"{WITH} select {K}, {r(f'sum((case when label = 1 then 2e0 else 1e0 end) * ({LOSS})) / sum(case when label = 1 then 2e0 else 1e0 end)')} "
       f"as log_loss from scores group by {K}")
def weighted_log_loss(spark, sf):
    return rounded(ev.weighted_log_loss(V.scores(spark, sf), {1: 2.0, 0: 1.0}), "log_loss")


# Eleven epochs of scores: the share of signal grows with the epoch.
EPOCH_SCORE = "least(1e0, cast((case_id * 7919 + epoch * 31) % 1000 as double) / 1e3 + 5e-2 * epoch * label)"
EPOCHS_CTE = (f"{V.CASE_ORDERS_SQL}, e as (select cast(i as int) as epoch from range(11) t(i)), "
              f"epochs as (select case_id, epoch, label, case_id // 64 as batch_id, {EPOCH_SCORE} as score "
              "from case_orders, e)")


def _epoch_scores(spark, sf):
    df = V.case_orders(spark, sf).select("case_id", "label", F.explode(F.sequence(F.lit(0), F.lit(10))).alias("epoch"))
    return df.select("case_id", "epoch", "label", F.floor(F.col("case_id") / 64).alias("batch_id"),
                     F.expr(EPOCH_SCORE).alias("score"))


@query("epoch_metrics", f"with {EPOCHS_CTE}, logged as (select * from epochs where epoch % 5 = 0), "
       f"c as ({counts_sql('epoch', '0.5e0', 'logged')}), a as ({auc_sql('epoch', 'logged')}), "
       f"b as (select epoch, batch_id, avg({LOSS}) as l from logged group by epoch, batch_id), "
       "l as (select epoch, avg(l) as log_loss from b group by epoch) "
       f"select epoch, tp, fn, tn, fp, {METRICS_SQL}, {r('log_loss')} as log_loss, {r('auc')} as auc "
       "from c join a using (epoch) join l using (epoch)")
def epoch_metrics(spark, sf):
    return rounded(ev.epoch_metrics(_epoch_scores(spark, sf)), *METRICS, "log_loss", "auc")


@query("best_epoch", f"with {EPOCHS_CTE}, a as ({auc_sql('epoch', 'epochs')}) select 'net' as model, epoch, "
       f"{r('auc')} as auc from (select *, row_number() over (order by round(auc, 12) desc, epoch) as rn from a) where rn = 1")
def best_epoch(spark, sf):
    log = ev.auc_rank(_epoch_scores(spark, sf), ["epoch"]).select(
        F.lit("net").alias("model"), "epoch", F.round("auc", 12).alias("auc"))
    return rounded(ev.best_epoch(log), "auc")
