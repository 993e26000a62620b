"""Queries of the vector, loss, acceptance, schedule and comparison operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomspark.functions import vectors as vx
from loomspark.operators import accept
from loomspark.operators import payload
from loomspark.operators.nearest import nearest_by_cosine
from loomspark.operators.readbench import read_list
from loomspark.runtime import table
from loomspark.sources import jsonl

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


# ---------------------------------------------------------------- vectors: embeddings stand for logits and hidden states


def _e(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").withColumn("x", vx.doubles(F.col("embedding")))


_E_SQL = "e AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings)"
_DOT = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i] * {b}[i]))"


@query(f"WITH {_E_SQL} SELECT vec_id, CAST(list_position(x, list_max(x)) - 1 AS INT) AS top, round(sqrt({_DOT.format(a='x', b='x')}), 6) AS norm FROM e")
def vec_argmax_norm(spark, sf_dir):
    return _e(spark, sf_dir).select("vec_id", vx.argmax(F.col("x")).alias("top"), F.round(vx.norm(F.col("x")), 6).alias("norm"))


@query(f"""WITH {_E_SQL}, s AS (SELECT vec_id, list_transform(x, lambda v: exp(v - list_max(x))) AS p FROM e) SELECT vec_id, round(list_max(p) / list_sum(p), 6) AS top_p, round(p[1] / list_sum(p), 6) AS first_p FROM s""")
def vec_softmax(spark, sf_dir):
    p = vx.softmax(F.col("x"))
    return _e(spark, sf_dir).select("vec_id", F.round(F.array_max(p), 6).alias("top_p"), F.round(F.get(p, 0), 6).alias("first_p"))


def _pairs(spark, sf_dir):
    """Draft and target: each vector and the one whose id follows."""
    e = _e(spark, sf_dir)
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("t"))
    return e.select("vec_id", "label", F.col("x").alias("d")).join(nxt, "vec_id")


_PAIR_SQL = f"""{_E_SQL}, pr AS (SELECT a.vec_id, a.label, a.x AS d, b.x AS t FROM e a JOIN e b ON b.vec_id = a.vec_id + 1),
 sm AS (SELECT *, list_sum(list_transform(d, lambda v: exp(v))) AS zd, list_sum(list_transform(t, lambda v: exp(v))) AS zt, list_position(d, list_max(d)) AS ad, list_position(t, list_max(t)) AS at_, list_sum(list_transform(d, lambda v: exp(v / 2))) AS zd2, list_sum(list_transform(t, lambda v: exp(v / 2))) AS zt2 FROM pr),
 loss AS (SELECT vec_id, label, ad = at_ AS hit, ln(zd) - d[at_] AS argmax_ce, ln(zd) - d[label % 64 + 1] AS hard_ce, 4 * list_sum(list_transform(range(1, len(d) + 1), lambda i: exp(t[i] / 2) / zt2 * (ln(zd2) - d[i] / 2))) AS soft_ce_2, list_sum(list_transform(range(1, len(d) + 1), lambda i: exp(t[i]) / zt * (ln(zd) - d[i]))) AS soft_ce, list_sum(list_transform(range(1, len(d) + 1), lambda i: abs(exp(d[i]) / zd - exp(t[i]) / zt))) AS l1 FROM sm)"""


def _losses(spark, sf_dir):
    """Loss terms of each pair; the label, within the width, stands for the token that was said."""
    d, t = F.col("d"), F.col("t")
    said = F.pmod("label", F.lit(64)).cast("int")
    terms = [vx.nll(d, vx.argmax(t)).alias("argmax_ce"), vx.nll(d, said).alias("hard_ce"), vx.soft_cross_entropy(d, t).alias("soft_ce"), vx.soft_cross_entropy(d, t, 2.0).alias("soft_ce_2"), vx.l1(d, t).alias("l1")]
    return _pairs(spark, sf_dir).select("vec_id", "label", (vx.argmax(d) == vx.argmax(t)).alias("hit"), *terms)


@query(f"WITH {_PAIR_SQL} SELECT vec_id, hit, round(argmax_ce, 6) AS argmax_ce, round(hard_ce, 6) AS hard_ce, round(soft_ce, 6) AS soft_ce, round(l1, 6) AS l1 FROM loss")
def vec_losses(spark, sf_dir):
    return _losses(spark, sf_dir).select("vec_id", "hit", *[F.round(c, 6).alias(c) for c in ("argmax_ce", "hard_ce", "soft_ce", "l1")])


@query(f"""WITH {_PAIR_SQL} SELECT count(*) AS supervised, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) AS greedy_accept, round(avg(argmax_ce), 5) AS argmax_ce, round(avg(soft_ce_2), 5) AS soft_ce, round(avg(l1), 5) AS l1,
 round(coalesce(avg(argmax_ce + 0.5 * soft_ce_2 + 0.2 * l1 + 0.1 * hard_ce), 0), 5) AS loss FROM loss WHERE label % 2 = 0""")
def loss_full_sequence(spark, sf_dir):
    """The loss of one aligned step over whole sequences: the mean over supervised places, at temperature 2; 0 without any."""
    s = _losses(spark, sf_dir).where(F.pmod("label", F.lit(2)) == 0)
    loss = F.avg(F.col("argmax_ce") + 0.5 * F.col("soft_ce_2") + 0.2 * F.col("l1") + 0.1 * F.col("hard_ce"))
    means = [F.round(F.avg(c), 5).alias(n) for c, n in (("argmax_ce", "argmax_ce"), ("soft_ce_2", "soft_ce"), ("l1", "l1"))]
    return s.agg(F.count("*").alias("supervised"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("greedy_accept"), *means, F.round(F.coalesce(loss, F.lit(0.0)), 5).alias("loss"))


@query(f"""WITH {_PAIR_SQL} SELECT ad = at_ AS hit, count(*) AS n, round(avg(sqrt({_DOT.format(a='d', b='d')})), 6) AS draft_norm, round(avg(sqrt({_DOT.format(a='t', b='t')})), 6) AS target_norm FROM sm GROUP BY 1""")
def norms_by_hit(spark, sf_dir):
    """Mean norms of both sides, where they agree on the next token and where they don't."""
    d, t = F.col("d"), F.col("t")
    p = _pairs(spark, sf_dir).select((vx.argmax(d) == vx.argmax(t)).alias("hit"), vx.norm(d).alias("dn"), vx.norm(t).alias("tn"))
    return p.groupBy("hit").agg(F.count("*").alias("n"), F.round(F.avg("dn"), 6).alias("draft_norm"), F.round(F.avg("tn"), 6).alias("target_norm"))


@query(f"WITH {_PAIR_SQL} SELECT CAST(label % 5 AS INT) AS step, count(*) AS num, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) AS accept, round(avg(argmax_ce), 5) AS argmax_ce, round(avg(soft_ce), 5) AS soft_ce, round(avg(l1), 5) AS l1 FROM loss GROUP BY 1")
def loss_by_step(spark, sf_dir):
    """Per-step means of the loss terms; steps without pairs don't occur."""
    step = F.pmod("label", F.lit(5)).cast("int").alias("step")
    means = [F.round(F.avg(c), 5).alias(c) for c in ("argmax_ce", "soft_ce", "l1")]
    return _losses(spark, sf_dir).groupBy(step).agg(F.count("*").alias("num"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("accept"), *means)


@query(f"WITH {_PAIR_SQL} SELECT round(sum(exp(-(label % 5) / 4.0) * (0.5 * argmax_ce + 0.3 * soft_ce + 0.2 * l1)) / greatest(sum(exp(-(label % 5) / 4.0)), 1), 5) AS loss FROM loss")
def loss_total(spark, sf_dir):
    """Weighted terms over the weighted number of supervised places."""
    w = F.exp(-F.pmod("label", F.lit(5)) / F.lit(4.0))
    term = 0.5 * F.col("argmax_ce") + 0.3 * F.col("soft_ce") + 0.2 * F.col("l1")
    return _losses(spark, sf_dir).agg(F.round(F.sum(w * term) / F.greatest(F.sum(w), F.lit(1.0)), 5).alias("loss"))


@query(f"""WITH {_PAIR_SQL}, c AS (SELECT vec_id, {_DOT.format(a='d', b='t')} / (greatest(sqrt({_DOT.format(a='d', b='d')}), 1e-6) * greatest(sqrt({_DOT.format(a='t', b='t')}), 1e-6)) AS cos, list_max(list_transform(range(1, len(d) + 1), lambda i: abs(d[i] - t[i]))) AS diff, list_position(d, list_max(d)) <> list_position(t, list_max(t)) AS flip,
  sqrt({_DOT.format(a='d', b='d')}) / sqrt({_DOT.format(a='t', b='t')}) AS ratio FROM pr)
 SELECT round(min(cos), 6) AS least_cosine, round(avg(cos), 6) AS mean_cosine, round(max(diff), 6) AS most_diff, count(*) FILTER (diff = 0) AS exact, count(*) FILTER (flip) AS flips, round(avg(ratio), 6) AS mean_ratio, CASE WHEN count(*) FILTER (flip) = 0 THEN 'harmless' ELSE 'changes decisions' END AS verdict FROM c""")
def vec_agreement(spark, sf_dir):
    d, t = F.col("d"), F.col("t")
    c = _pairs(spark, sf_dir).select(vx.cosine(d, t).alias("cos"), vx.max_abs_diff(d, t).alias("diff"), (vx.argmax(d) != vx.argmax(t)).alias("flip"), (vx.norm(d) / vx.norm(t)).alias("ratio"))
    return c.agg(F.round(F.min("cos"), 6).alias("least_cosine"), F.round(F.avg("cos"), 6).alias("mean_cosine"), F.round(F.max("diff"), 6).alias("most_diff"), F.count_if(F.col("diff") == 0).alias("exact"), F.count_if("flip").alias("flips"), F.round(F.avg("ratio"), 6).alias("mean_ratio"),
                 F.when(F.count_if("flip") == 0, "harmless").otherwise("changes decisions").alias("verdict"))


@query(f"""WITH {_E_SQL}, q AS (SELECT * FROM e WHERE vec_id % 50 = 0), c AS (SELECT q.vec_id, e.vec_id AS near, {_DOT.format(a='q.x', b='e.x')} / (sqrt({_DOT.format(a='q.x', b='q.x')}) * sqrt({_DOT.format(a='e.x', b='e.x')})) AS cos FROM q, e WHERE q.vec_id <> e.vec_id)
 SELECT vec_id, arg_max(near, cos) AS near, round(max(cos), 6) AS cosine FROM c GROUP BY vec_id""")
def vec_nearest(spark, sf_dir):
    """The nearest of all vectors for each query, a row whose id is divisible by 50."""
    e = _e(spark, sf_dir)
    return nearest_by_cosine(e.where("vec_id % 50 = 0"), e, "vec_id", "x").select("vec_id", "near", F.round("cosine", 6).alias("cosine"))


@query(f"""WITH {_PAIR_SQL} SELECT vec_id, CAST(len(d) + len(t) AS INT) AS width, round(list_sum(list_transform(range(1, len(d) + 1), lambda i: CASE WHEN i - 1 <= 20 THEN d[i] ELSE 0 END)), 6) AS causal_sum, round(list_sum(list_transform(range(1, len(d) + 1), lambda i: CASE WHEN i - 1 <= 20 AND i - 1 > 12 THEN d[i] ELSE 0 END)), 6) AS sliding_sum,
 round(list_sum(list_transform(d, lambda v: 30.0 * (exp(2 * v / 30.0) - 1) / (exp(2 * v / 30.0) + 1))), 6) AS capped_sum FROM pr""")
def vec_masks(spark, sf_dir):
    d = F.col("d")
    total = lambda x: F.round(F.aggregate(x, F.lit(0.0), lambda a, v: a + v), 6)
    n, at = F.size(d), F.lit(20)
    return _pairs(spark, sf_dir).select("vec_id", F.size(F.concat("d", "t")).alias("width"), total(vx.masked(d, vx.causal_mask(n, at))).alias("causal_sum"), total(vx.masked(d, vx.sliding_mask(n, at, 8))).alias("sliding_sum"), total(vx.soft_cap(d, 30.0)).alias("capped_sum"))


@query("""WITH r AS (SELECT vec_id, list_transform(range(0, 16), lambda i: embedding[i * 4 + 1 : i * 4 + 4]) AS m FROM embeddings) SELECT vec_id, list_transform(range(1, 5), lambda h: list_transform(m, lambda t: round(CAST(t[h] AS DOUBLE), 6))) AS m FROM r""")
def vec_transpose(spark, sf_dir):
    m = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice(F.col("x"), i * 4 + 1, F.lit(4)))
    return _e(spark, sf_dir).select("vec_id", m.alias("m")).select("vec_id", F.transform(vx.transpose(F.col("m")), lambda r: F.transform(r, lambda v: F.round(v, 6))).alias("m"))


@query("""SELECT vec_id, CAST(k.unnest AS INT) AS step, CAST(64 - k.unnest - 1 AS INT) AS length, round(CAST(embedding[k.unnest + 1] AS DOUBLE), 6) AS hidden_first, round(CAST(embedding[k.unnest + 2] AS DOUBLE), 6) AS target_first, round(CAST(embedding[least(10 + k.unnest + 3, 64)] AS DOUBLE), 6) AS anchor_truth FROM embeddings, unnest(range(0, 5)) AS k""")
def step_alignment(spark, sf_dir):
    """Step k sees ``[k, k + L)`` and is held against ``[k + 1, k + 1 + L)``; an anchor's truth is at ``anchor + k + 2``, within bounds."""
    e = _e(spark, sf_dir).select("vec_id", "x", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("step"))
    n = F.size("x") - F.col("step") - 1
    hidden, target = F.slice(F.col("x"), F.col("step") + 1, n), F.slice(F.col("x"), F.col("step") + 2, n)
    truth = F.element_at("x", F.least(F.lit(10) + F.col("step") + 3, F.size("x")))
    return e.select("vec_id", "step", F.size(hidden).alias("length"), F.round(F.get(hidden, 0), 6).alias("hidden_first"), F.round(F.get(target, 0), 6).alias("target_first"), F.round(truth, 6).alias("anchor_truth"))


# ---------------------------------------------------------------- acceptance: two answers of a conversation stand for draft and target

_TURNS_SQL = r"""a AS (SELECT regen_id, list_transform(list_filter(conversations, lambda m: m.role = 'assistant' AND m.content IS NOT NULL), lambda m: regexp_extract_all(m.content, '[A-Za-z]+')) AS ts FROM regen_rows),
 dt AS (SELECT regen_id, CAST(i.unnest AS INT) AS turn, ts[i.unnest][1:5] AS draft, ts[i.unnest + 1][1:5] AS target FROM a, unnest(range(1, len(ts))) AS i WHERE len(ts[i.unnest]) >= 5 AND len(ts[i.unnest + 1]) >= 5),
 ac AS (SELECT *, coalesce(list_position(list_transform(range(1, 6), lambda j: draft[j] = target[j]), false) - 1, 5) AS acc FROM dt)"""


def _drafts(spark, sf_dir):
    said = F.filter("conversations", lambda m: (m["role"] == "assistant") & m["content"].isNotNull())
    a = table(spark, sf_dir, "regen_rows").select("regen_id", F.transform(said, lambda m: F.regexp_extract_all(m["content"], F.lit("[A-Za-z]+"), F.lit(0))).alias("ts"))
    t = a.where(F.size("ts") >= 2).select("regen_id", "ts", F.explode(F.sequence(F.lit(1), F.size("ts") - 1)).alias("turn"))
    d, x = F.element_at("ts", F.col("turn")), F.element_at("ts", F.col("turn") + 1)
    return t.select("regen_id", "turn", d.alias("d"), x.alias("x")).where("size(d) >= 5 AND size(x) >= 5").select("regen_id", "turn", F.slice("d", 1, 5).alias("draft"), F.slice("x", 1, 5).alias("target"))


@query(f"WITH {_TURNS_SQL} SELECT regen_id, turn, CAST(acc AS INT) AS accepted, CAST(1 + acc + CASE WHEN acc < 5 THEN 1 ELSE 0 END AS INT) AS committed, CASE WHEN acc < 5 THEN CAST(acc AS INT) END AS divergence FROM ac")
def accept_prefix(spark, sf_dir):
    d, t = F.col("draft"), F.col("target")
    return _drafts(spark, sf_dir).select("regen_id", "turn", accept.accepted(d, t).alias("accepted"), F.size(accept.committed(F.lit("<first>"), d, t)).alias("committed"), accept.first_divergence(d, t).cast("int").alias("divergence"))


@query(f"WITH {_TURNS_SQL} SELECT count(*) AS drafts, CAST(count(*) * 5 AS BIGINT) AS draft_tokens, CAST(sum(acc) AS BIGINT) AS accepted, CAST(sum(least(acc + 1, 5)) AS BIGINT) AS examined, round(sum(acc) / (count(*) * 5), 6) AS accept_rate_k, round(sum(acc) / sum(least(acc + 1, 5)), 6) AS accept_rate_examined, round(1 + sum(acc) / count(*), 6) AS accept_len FROM ac")
def accept_metrics(spark, sf_dir):
    a = accept.acceptance(_drafts(spark, sf_dir), "draft", "target")
    return a.select("drafts", "draft_tokens", "accepted", "examined", *[F.round(c, 6).alias(c) for c in ("accept_rate_k", "accept_rate_examined", "accept_len")])


@query(f"WITH {_TURNS_SQL} SELECT CAST(k.unnest AS INT) AS place, count(*) AS drafts, count(*) FILTER (acc > k.unnest) AS accepted, round(avg(CASE WHEN acc > k.unnest THEN 1.0 ELSE 0.0 END), 6) AS rate FROM ac, unnest(range(0, 5)) AS k GROUP BY 1")
def accept_per_position(spark, sf_dir):
    return accept.acceptance_by_place(_drafts(spark, sf_dir), "draft", "target").withColumn("rate", F.round("rate", 6))


@query(f"""WITH {_TURNS_SQL}, h AS (SELECT CAST(k.unnest AS INT) AS step, CASE WHEN turn = 1 THEN 'first' ELSE 'later' END AS regime, draft[k.unnest + 1] = target[k.unnest + 1] AS hit FROM dt, unnest(range(0, 5)) AS k)
 SELECT step, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) FILTER (regime = 'first'), 6) AS first, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) FILTER (regime = 'later'), 6) AS later FROM h GROUP BY step""")
def accept_matrix(spark, sf_dir):
    """Hit rate per step and regime, as a matrix."""
    h = _drafts(spark, sf_dir).select(F.when(F.col("turn") == 1, "first").otherwise("later").alias("regime"), F.posexplode(F.zip_with("draft", "target", lambda a, b: (a == b).cast("double"))).alias("step", "hit"))
    return h.groupBy("step").pivot("regime", ["first", "later"]).agg(F.round(F.avg("hit"), 6))


@query(f"WITH {_TURNS_SQL} SELECT regen_id, turn, draft[1] = target[1] AS first_hit, (length(target[1]) > 0 AND length(draft[1]) / length(target[1]) >= 0.5) AS accepted FROM dt")
def accept_rejection(spark, sf_dir):
    """Rejection sampling with given uniform numbers: here the lengths of the first words stand for the probabilities."""
    p, q = F.length(F.get("draft", 0)).cast("double"), F.length(F.get("target", 0)).cast("double")
    return _drafts(spark, sf_dir).select("regen_id", "turn", (F.get("draft", 0) == F.get("target", 0)).alias("first_hit"), accept.rejection_accept(p, q, F.lit(0.5)).alias("accepted"))


@query(f"""WITH {_TURNS_SQL}, h AS (SELECT draft[1] = target[1] AS a, draft[2] = target[2] AS b FROM dt)
 SELECT round(avg(CASE WHEN a THEN 1.0 ELSE 0.0 END), 6) AS first_rate, round(avg(CASE WHEN b THEN 1.0 ELSE 0.0 END), 6) AS second_rate, round(avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END), 6) AS agreement, count(*) FILTER (a AND b) AS both FROM h""")
def hit_agreement(spark, sf_dir):
    h = _drafts(spark, sf_dir).select((F.get("draft", 0) == F.get("target", 0)).alias("a"), (F.get("draft", 1) == F.get("target", 1)).alias("b"))
    rate = lambda c: F.round(F.avg(c.cast("double")), 6)
    return h.agg(rate(F.col("a")).alias("first_rate"), rate(F.col("b")).alias("second_rate"), rate(F.col("a") == F.col("b")).alias("agreement"), F.count_if(F.col("a") & F.col("b")).alias("both"))


# ---------------------------------------------------------------- schedules


@query("""WITH b AS (SELECT source AS layer, count(*) AS n FROM documents GROUP BY 1), s AS (SELECT layer, n, greatest(1, 64 // (2 * 8)) AS accum, CAST(ceil(n / 64.0) AS BIGINT) AS per_epoch FROM b)
 SELECT layer, CAST(accum AS INT) AS accum, (greatest(1, n // 16) // accum) * 3 AS optimiser_steps, CAST(greatest(1, round_even(greatest(1, per_epoch) * 3 * 0.04, 0)) AS BIGINT) AS warmup, printf('%d:%02d:%02d', n * 7 // 3600, (n * 7 % 3600) // 60, n * 7 % 60) AS eta FROM s""")
def training_schedule(spark, sf_dir):
    """Accumulation, steps, warm-up and time left for so many samples per layer."""
    b = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("layer")).agg(F.count("*").alias("n"))
    accum = F.greatest(F.lit(1), F.expr("64 div (2 * 8)")).cast("int")
    steps = F.expr("greatest(1, n div 16)")
    sec = F.col("n") * 7
    return b.select("layer", accum.alias("accum"), (F.floor(steps / accum) * 3).alias("optimiser_steps"), F.greatest(F.lit(1.0), F.rint(F.greatest(F.lit(1), F.ceil(F.col("n") / 64)) * 3 * F.lit(0.04))).cast("bigint").alias("warmup"),
                    F.format_string("%d:%02d:%02d", F.floor(sec / 3600), F.floor((sec % 3600) / 60), sec % 60).alias("eta"))


@query("SELECT CAST(s AS INT) AS step, round(CASE WHEN s < 20 THEN s / 20.0 ELSE 0.5 * (1 + cos(pi() * (s - 20) / (200 - 20.0))) END, 6) AS rate FROM range(0, 201) AS t(s)")
def learning_rate(spark, sf_dir):
    """Linear warm-up, then a cosine to 0."""
    s = F.col("id")
    rate = F.when(s < 20, s / 20.0).otherwise(0.5 * (1 + F.cos(F.pi() * (s - 20) / (200 - 20.0))))
    return spark.range(201).select(s.cast("int").alias("step"), F.round(rate, 6).alias("rate"))


@query("SELECT CAST(k AS INT) AS step, round(exp(-k / 4.0), 9) AS weight, CAST(1.0 AS DOUBLE) AS flat FROM range(0, 5) AS t(k)")
def step_weights(spark, sf_dir):
    rows = list(zip(range(5), vx.step_weights(5, 4.0), vx.step_weights(5, 0.0)))
    return spark.createDataFrame(rows, "step int, weight double, flat double").withColumn("weight", F.round("weight", 9))


# ---------------------------------------------------------------- key and shape comparisons: suppliers and customers stand for two checkpoints


def _keys(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.concat(F.when(F.pmod("s_suppkey", F.lit(3)) == 0, "model.pre_projection.").when(F.pmod("s_suppkey", F.lit(3)) == 1, "lm_head.").otherwise("layers."), "s_suppkey").alias("key"), F.array("s_nationkey", F.pmod("s_suppkey", F.lit(7)).cast("int")).alias("shape"))
    c = table(spark, sf_dir, "customer").select(F.concat(F.when(F.pmod("c_custkey", F.lit(3)) == 0, "model.pre_projection.").when(F.pmod("c_custkey", F.lit(3)) == 1, "lm_head.").otherwise("layers."), "c_custkey").alias("key"), F.array("c_nationkey", F.pmod("c_custkey", F.lit(7)).cast("int")).alias("shape"))
    return s, c


_KEYS_SQL = """s AS (SELECT CASE s_suppkey % 3 WHEN 0 THEN 'model.pre_projection.' WHEN 1 THEN 'lm_head.' ELSE 'layers.' END || s_suppkey AS key, [s_nationkey, CAST(s_suppkey % 7 AS INT)] AS shape FROM supplier),
 c AS (SELECT CASE c_custkey % 3 WHEN 0 THEN 'model.pre_projection.' WHEN 1 THEN 'lm_head.' ELSE 'layers.' END || c_custkey AS key, [c_nationkey, CAST(c_custkey % 7 AS INT)] AS shape FROM customer)"""


@query(f"WITH {_KEYS_SQL} (SELECT key, 'only in first' AS side FROM (SELECT key FROM s EXCEPT SELECT key FROM c)) UNION ALL (SELECT key, 'only in second' AS side FROM (SELECT key FROM c EXCEPT SELECT key FROM s))")
def key_diff(spark, sf_dir):
    s, c = (x.select("key").distinct() for x in _keys(spark, sf_dir))
    return s.exceptAll(c).withColumn("side", F.lit("only in first")).unionByName(c.exceptAll(s).withColumn("side", F.lit("only in second")))


@query(f"WITH {_KEYS_SQL} SELECT key, s.shape AS first_shape, c.shape AS second_shape FROM s JOIN c USING (key) WHERE s.shape <> c.shape")
def shape_mismatch(spark, sf_dir):
    s, c = _keys(spark, sf_dir)
    return s.join(c.withColumnRenamed("shape", "second_shape"), "key").where("shape <> second_shape").select("key", F.col("shape").alias("first_shape"), "second_shape")


@query(f"""WITH {_KEYS_SQL} SELECT CASE WHEN contains(key, 'projection') THEN 'projection' WHEN contains(key, 'lm_head') THEN 'lm_head' WHEN contains(key, 'embed_tokens') THEN 'embed_tokens' ELSE 'other' END AS kind, count(*) AS keys,
 CASE WHEN bool_or(starts_with(key, 'model.pre_projection') OR starts_with(key, 'model.post_projection')) THEN 'nested' WHEN bool_or(starts_with(key, 'pre_projection') OR starts_with(key, 'post_projection')) THEN 'top level' ELSE 'unexpected prefix' END AS verdict FROM s GROUP BY 1""")
def key_classes(spark, sf_dir):
    k = F.col("key")
    kind = F.when(k.contains("projection"), "projection").when(k.contains("lm_head"), "lm_head").when(k.contains("embed_tokens"), "embed_tokens").otherwise("other")
    starts = lambda *p: F.bool_or(k.startswith(p[0]) | k.startswith(p[1]))
    verdict = F.when(starts("model.pre_projection", "model.post_projection"), "nested").when(starts("pre_projection", "post_projection"), "top level").otherwise("unexpected prefix")
    return _keys(spark, sf_dir)[0].groupBy(kind.alias("kind")).agg(F.count("*").alias("keys"), verdict.alias("verdict"))


@query("""SELECT n_nationkey, k.unnest AS key, CASE WHEN k.unnest = 'absent' THEN '(absent)' WHEN k.unnest = 'width' AND n_nationkey % 2 = 0 THEN CAST(n_regionkey AS VARCHAR) WHEN k.unnest = 'width' THEN CAST(n_nationkey AS VARCHAR) WHEN n_nationkey % 2 = 0 THEN '(absent)' ELSE n_name END AS value
 FROM nation, unnest(['width', 'name', 'absent']) AS k""")
def config_nested(spark, sf_dir):
    """Configurations that have a ``text_config`` and some that don't: where there is one, only its keys count."""
    top = [F.col("n_nationkey").alias("width"), F.col("n_name").alias("name")]
    nested = F.struct(*top, F.struct(F.col("n_regionkey").alias("width")).alias("text_config"))
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.when(F.pmod("n_nationkey", F.lit(2)) == 0, F.to_json(nested)).otherwise(F.to_json(F.struct(*top))).alias("config"))
    return jsonl.config_values(n, "config", ["width", "name", "absent"])


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 5")
def slowest_five(spark, sf_dir):
    """The five slowest reads of a log: a top-k report."""
    return table(spark, sf_dir, "events").select("event_id", "value").orderBy(F.desc("value"), "event_id").limit(5)


@query("SELECT shard_id, count(*) AS samples, CAST(sum(seq_len) AS BIGINT) AS tokens, round(avg(seq_len), 6) AS mean_tokens, min(seq_len) AS least, max(seq_len) AS most, CAST(floor(quantile_cont(seq_len, 0.5)) AS BIGINT) AS p50, CAST(floor(quantile_cont(seq_len, 0.9)) AS BIGINT) AS p90, CAST(floor(quantile_cont(seq_len, 0.99)) AS BIGINT) AS p99 FROM sample_index GROUP BY shard_id")
def sample_lengths(spark, sf_dir):
    return table(spark, sf_dir, "sample_index").groupBy("shard_id").agg(F.count("*").alias("samples"), F.sum(F.col("seq_len").cast("bigint")).alias("tokens"), F.round(F.avg("seq_len"), 6).alias("mean_tokens"), F.min("seq_len").alias("least"), F.max("seq_len").alias("most"), *[F.percentile("seq_len", F.lit(q)).cast("bigint").alias(n) for n, q in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99))])


@query("""SELECT s.sample_id, r.regen_id, CAST(len(r.conversations) AS INT) AS messages, s.seq_len FROM sample_index s JOIN regen_rows r ON s.regen_id = r.regen_id""")
def sample_lookup(spark, sf_dir):
    """Samples with the rows they were made of."""
    s, r = table(spark, sf_dir, "sample_index"), table(spark, sf_dir, "regen_rows").select("regen_id", F.size("conversations").alias("messages"))
    return s.join(r, "regen_id").select("sample_id", "regen_id", "messages", "seq_len")


@query("""WITH r AS (SELECT sample_id, shard_id, seq_len, row_number() OVER (ORDER BY md5(sample_id || ':0'), sample_id) - 1 AS rnd, row_number() OVER (ORDER BY sample_id) - 1 AS seq FROM sample_index)
 SELECT 'random' AS mode, CAST(rnd AS INT) AS place, sample_id, shard_id, seq_len FROM r WHERE rnd < 200 UNION ALL SELECT 'seq' AS mode, CAST(seq AS INT) AS place, sample_id, shard_id, seq_len FROM r WHERE seq < 200""")
def read_lists(spark, sf_dir):
    """Which samples a read benchmark asks for: a sampling operator of 200 each way."""
    i = table(spark, sf_dir, "sample_index")
    return read_list(i, 200, "random").withColumn("mode", F.lit("random")).unionByName(read_list(i, 200, "seq").withColumn("mode", F.lit("seq")))


@query("SELECT vec_id, CAST(16 AS INT) AS seq_len, CAST(64 + 16 + 128 + 128 AS INT) AS nbytes, true AS same, true AS close FROM embeddings")
def payload_round_trip(spark, sf_dir):
    """Each vector as a sample of 16 tokens, through bytes and back; bfloat16 keeps 8 bits of the fraction."""
    x = F.col("x")
    rows = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice(x, i * 4 + 1, F.lit(4)))
    ids = F.sequence(F.lit(0), F.lit(15))
    s = _e(spark, sf_dir).select("vec_id", ids.alias("ids"), F.transform(ids, lambda i: i % 2).alias("mask"), rows.alias("h"), F.array(F.transform(rows, lambda r: F.slice(r, 1, 2)), F.transform(rows, lambda r: F.slice(r, 3, 2))).alias("kv"))
    e = payload.encode_samples(s, "vec_id", "ids", "mask", "h", "kv")
    n = F.octet_length("input_ids") + F.octet_length("loss_mask") + F.octet_length("last_hidden") + F.octet_length("kv")
    d = payload.decode_samples(e, "vec_id", 2).join(e.select("vec_id", "seq_len", n.alias("nbytes")), "vec_id").join(_e(spark, sf_dir).select("vec_id", "x"), "vec_id")
    off = F.zip_with(F.flatten("last_hidden"), "x", lambda a, b: F.abs(a - b) <= F.abs(b) / 128 + 1e-9)
    again = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.concat(F.col("kv")[0][i], F.col("kv")[1][i])))
    return d.select("vec_id", "seq_len", "nbytes", ((F.col("input_ids") == ids) & (again == F.flatten("last_hidden"))).alias("same"), F.forall(off, lambda v: v).alias("close"))
