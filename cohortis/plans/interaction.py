"""Attention, normalisation and dense-layer queries over the embedding table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from cohortis.functions import arrays as A
from cohortis.functions import encode as enc
from cohortis.functions.dense import dense, logit_head
from cohortis.models.attention import AttentionNetwork
from cohortis.operators import interact as it
from cohortis.plans.registry import query, r, rounded
from cohortis.sources import views as V

D = 64
HIDDEN = 300
P = it.Projections(theta=(0.5, 0.1), phi=(0.4, -0.1), g=(0.8, 0.05), out=(0.6, 0.02))

# Weights are formulas of their indices, so that SQL can state them too.
LONG = ("v as (select vec_id, cast(label as int) as label, embedding::double[] as x from embeddings), "
        "xl as (select vec_id, unnest(range(64)) as j, unnest(x) as v from v)")


def weights(rows: int, cols: int, seed: int):
    i, j = np.indices((rows, cols))
    return ((i * 31 + j * 17 + seed * 7) % 13 - 6) / 50.0, ((np.arange(rows) * 5 + seed) % 7 - 3) / 20.0


def head_weights(cols: int, seed: int):
    return ((np.arange(cols) * 17 + seed * 7) % 13 - 6) / 50.0, (seed % 7 - 3) / 20.0


def linear_sql(src: str, rows: int, seed: int, act: str = "{}") -> str:
    """Long-form (vec_id, j, v) -> act(W x + b)."""
    dot = f"sum(v * ((i * 31 + j * 17 + {seed} * 7) % 13 - 6) / 50e0) + ((i * 5 + {seed}) % 7 - 3) / 20e0"
    return (f"(select vec_id, i as j, {act.format(dot)} as v from {src}, range({rows}) t(i) group by vec_id, i)")


def head_sql(src: str, seed: int) -> str:
    dot = f"sum(v * ((j * 17 + {seed} * 7) % 13 - 6) / 50e0) + ({seed} % 7 - 3) / 20e0"
    return f"(select vec_id, 1 / (1 + exp(-({dot}))) as score from {src} group by vec_id)"


def affine_sql(p) -> str:
    return f"({{}} * {float(p[0])}e0 + {float(p[1])}e0)"


def map_sql(q: str, k: str, on: str = "true") -> str:
    """Long-form map (vec_id, i, j, w) from two long-form vectors."""
    return (f"(select vec_id, i, j, exp(s - max(s) over (partition by vec_id, i)) / "
            f"sum(exp(s - m)) over (partition by vec_id, i) as w from (select *, max(s) over (partition by vec_id, i) as m "
            f"from (select q.vec_id, q.j as i, k.j as j, q.v * k.v as s from {q} q join {k} k on q.vec_id = k.vec_id and {on})))")


def attend_sql(q: str, k: str, v: str, on: str = "true") -> str:
    return (f"(select m.vec_id, m.i as j, sum(m.w * g.v) as v from {map_sql(q, k, on)} m join {v} g "
            f"on g.vec_id = m.vec_id and g.j = m.j group by m.vec_id, m.i)")


def projected_sql(p) -> str:
    return "(select vec_id, j, " + affine_sql(p).format("v") + " as v from xl)"


def batch_norm_sql(src: str) -> str:
    return (f"(select vec_id, j, (v - avg(v) over (partition by j)) / sqrt(var_pop(v) over (partition by j) + 1e-5) as v "
            f"from {src})")


def stored_norm_sql(src: str) -> str:
    return f"(select vec_id, j, (v - (j % 5) / 10e0) / sqrt(1 + (j % 3) / 10e0 + 1e-5) as v from {src})"


def stored_stats(n: int) -> it.BatchStats:
    j = np.arange(n)
    return it.BatchStats(tuple((j % 5) / 10.0), tuple(1 + (j % 3) / 10.0))


def add_sql(a: str, b: str) -> str:
    return f"(select a.vec_id, a.j, a.v + b.v as v from {a} a join {b} b on a.vec_id = b.vec_id and a.j = b.j)"


def long(df, col: str, names=("j", "v")):
    return rounded(df.select("vec_id", F.posexplode(col).alias(*names)), names[1])


def long_out(src: str) -> str:
    return f"select vec_id, cast(j as int) as j, {r('v')} as v from {src}"


@query("activations", f"with {LONG}, e as (select *, exp(v - max(v) over (partition by vec_id)) as e from xl) "
       f"select vec_id, cast(j as int) as j, {r('greatest(v, 0)')} as relu, {r('1 / (1 + exp(-v))')} as sigmoid, "
       f"{r('e / sum(e) over (partition by vec_id)')} as softmax from e")
def activations(spark, sf):
    df = V.vectors(spark, sf).select("vec_id", F.posexplode(F.arrays_zip(
        F.col("x").alias("v"), A.softmax("x").alias("s"))).alias("j", "z"))
    return rounded(df.select("vec_id", "j", enc.relu(F.col("z.v")).alias("relu"), enc.sigmoid(F.col("z.v")).alias("sigmoid"),
                             F.col("z.s").alias("softmax")), "relu", "sigmoid", "softmax")


# The full maps are d x d numbers per row; each is checked through one number per map row that
# depends on every cell of it, and its largest cell.
def _map_digest(df, col):
    rows = df.select("vec_id", F.posexplode(col).alias("i", "row"))
    cells = rows.select("vec_id", "i", F.posexplode("row").alias("j", "w"))
    digest = cells.groupBy("vec_id", "i").agg(
        F.sum(F.col("w") * (F.col("j") + 1)).alias("moment"), F.max("w").alias("largest"), F.sum("w").alias("total"))
    return rounded(digest, "moment", "largest", "total")


def _digest_sql(maps: str) -> str:
    return (f"with {LONG}, m as {maps} select vec_id, cast(i as int) as i, {r('sum(w * (j + 1))')} as moment, "
            f"{r('max(w)')} as largest, {r('sum(w)')} as total from m group by vec_id, i")


@query("attention_map", _digest_sql(map_sql(projected_sql(P.theta), projected_sql(P.phi))))
def attention_map(spark, sf):
    return _map_digest(V.vectors(spark, sf), it.attention_map(F.col("x"), P))


@query("interaction_map", _digest_sql(map_sql("xl", "xl")))
def interaction_map(spark, sf):
    return _map_digest(V.vectors(spark, sf), it.interaction_map(F.col("x")))


@query("masked_attention", _digest_sql(map_sql("xl", "xl", "k.j <= q.j")))
def masked_attention(spark, sf):
    return _map_digest(V.vectors(spark, sf), it.interaction_map(F.col("x"), causal=True))


@query("attention_output", f"with {LONG}, y as {attend_sql(projected_sql(P.theta), projected_sql(P.phi), projected_sql(P.g))} "
       f"select y.vec_id, cast(y.j as int) as j, {r('y.v * 0.6e0 + 0.02e0 + xl.v')} as v from y join xl using (vec_id, j)")
def attention_output(spark, sf):
    return long(V.vectors(spark, sf).select("vec_id", it.attention_output(F.col("x"), P).alias("z")), "z")


@query("maxpool_pairs", f"with {LONG} select vec_id, cast(j // 2 as int) as j, {r('max(v)')} as v from xl group by vec_id, j // 2")
def maxpool_pairs(spark, sf):
    return long(V.vectors(spark, sf).select("vec_id", A.max_pool("x").alias("z")), "z")


@query("batch_norm", f"with {LONG} {long_out(batch_norm_sql('xl'))}")
def batch_norm(spark, sf):
    return long(it.batch_norm(V.vectors(spark, sf), "x"), "x")


@query("dense_relu", f"with {LONG} {long_out(linear_sql('xl', HIDDEN, 1, 'greatest({}, 0)'))}")
def dense_relu(spark, sf):
    layer = dense(*weights(HIDDEN, D, 1), "relu")
    return long(V.vectors(spark, sf).select("vec_id", layer(F.col("x")).alias("h")), "h")


@query("score_head", f"with {LONG} select vec_id, {r('score')} as score from {head_sql('xl', 2)}")
def score_head(spark, sf):
    return rounded(V.vectors(spark, sf).select("vec_id", logit_head(*head_weights(D, 2))(F.col("x")).alias("score")), "score")


def fixed_network() -> AttentionNetwork:
    w1, b1 = weights(HIDDEN, D, 1)
    w2, b2 = head_weights(HIDDEN, 2)
    stats = stored_stats(HIDDEN)
    return AttentionNetwork.from_parts(P, w1, b1, w2, b2, stats.mean, stats.var)


_OUT_SQL = ("(select y.vec_id, y.j, (y.v * 0.6e0 + 0.02e0) / sqrt(1 + 1e-5) + xl.v as v from "
            f"{attend_sql(projected_sql(P.theta), projected_sql(P.phi), projected_sql(P.g))} y join xl using (vec_id, j))")
_RELU = "(select vec_id, j, greatest(v, 0) as v from {})"
_SCORE_SQL = (f"with {LONG}, z as {_OUT_SQL}, h as {linear_sql('z', HIDDEN, 1)}, n as {stored_norm_sql('h')}, "
              f"a as {_RELU.format('n')}, s as {head_sql('a', 2)} ")


@query("batch_score", _SCORE_SQL + f"select vec_id, cast(label % 2 as int) as label, {r('score')} as score from s join v using (vec_id)")
def batch_score(spark, sf):
    df = V.vectors(spark, sf).select("vec_id", (F.col("label") % 2).alias("label"), "x")
    return rounded(fixed_network().score(df, "x").select("vec_id", "label", "score"), "score")


@query("mean_attention_table", f"with {LONG}, m as {map_sql(projected_sql(P.theta), projected_sql(P.phi))} "
       f"select cast(i as int) as row_feature, cast(j as int) as col_feature, {r('avg(w)')} as weight from m group by i, j")
def mean_attention_table(spark, sf):
    return rounded(it.mean_attention_table(V.vectors(spark, sf), "x", P), "weight")


@query("outer_attention", f"with {LONG} {long_out(attend_sql('xl', 'xl', 'xl'))}")
def outer_attention(spark, sf):
    return long(V.vectors(spark, sf).select("vec_id", it.outer_attention(F.col("x")).alias("y")), "y")


@query("layer_norm", f"with {LONG} select vec_id, cast(j as int) as j, " + r(
    "(v - avg(v) over (partition by vec_id)) / sqrt(var_pop(v) over (partition by vec_id) + 1e-12)") + " as v from xl")
def layer_norm(spark, sf):
    return long(V.vectors(spark, sf).select("vec_id", it.layer_norm(F.col("x")).alias("y")), "y")


def _ff_sql(src: str, seed: int, norm) -> str:
    return norm(add_sql(linear_sql(src, D, seed, "greatest({}, 0)"), src))


@query("feed_forward_block", f"with {LONG} {long_out(_ff_sql('xl', 3, batch_norm_sql))}")
def feed_forward_block(spark, sf):
    return long(it.feed_forward_block(V.vectors(spark, sf), "x", *weights(D, D, 3)), "x")


def block_weights(seed: int) -> it.AttentionWeights:
    return it.AttentionWeights(*[weights(D, D, seed + i) for i in range(4)])


def _block_sql(src: str, seed: int, norm) -> str:
    q, k, v = (linear_sql(src, D, seed + i) for i in range(3))
    return norm(add_sql(linear_sql(attend_sql(q, k, v), D, seed + 3), src))


@query("attention_block", f"with {LONG} {long_out(_block_sql('xl', 4, batch_norm_sql))}")
def attention_block(spark, sf):
    return long(it.attention_block(V.vectors(spark, sf), "x", block_weights(4)), "x")


@query("encoder_score", f"with {LONG}, s0 as materialized {attend_sql('xl', 'xl', 'xl')}, "
       f"s1 as materialized {stored_norm_sql(linear_sql('s0', D, 8))}, "
       f"s2 as materialized {_block_sql('s1', 9, stored_norm_sql)}, s3 as materialized {_ff_sql('s2', 13, stored_norm_sql)}, "
       f"s4 as materialized {_block_sql('s3', 14, stored_norm_sql)}, s5 as materialized {_ff_sql('s4', 18, stored_norm_sql)} "
       f"select vec_id, {r('score')} as score from {head_sql('s5', 19)}")
def encoder_score(spark, sf):
    layers = it.StackWeights(
        embed=weights(D, D, 8), encoder=((block_weights(9), weights(D, D, 13)),),
        decoder=((block_weights(14), weights(D, D, 18)),), head=head_weights(D, 19), stats=stored_stats(D))
    return rounded(it.encoder_score(V.vectors(spark, sf), "x", layers).select("vec_id", "score"), "score")


@query("position_encode", f"with {LONG} select vec_id, cast(j as int) as j, " + r(
    "v * 8e0 + case when j % 2 = 0 then sin((vec_id % 20) / pow(1e4, 2e0 * j / 64e0)) "
    "else cos((vec_id % 20) / pow(1e4, 2e0 * j / 64e0)) end") + " as v from xl")
def position_encode(spark, sf):
    df = V.vectors(spark, sf).select("vec_id", it.position_encode(F.col("x"), F.col("vec_id") % 20, D).alias("y"))
    return long(df, "y")
