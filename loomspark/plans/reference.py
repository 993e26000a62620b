"""Queries of the conversation, cache, anchor, vector and acceptance operators, each with its SQL for comparison.

The SQL is written from the definition, not from the plan, and runs over the same whole tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from loomspark.functions import stats, text as tx, vectors as vx
from loomspark.functions.records import effective_id, effective_layer
from loomspark.operators import anchors, cache, complete, profile, routing
from loomspark.plans import stages
from loomspark.runtime import materialize, shared_dir, table, write_counted, written
from loomspark.sources import jsonl

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
SEED, EVAL_SHARE = 0, 0.1


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


# ---------------------------------------------------------------- conversations

_LAYER_SQL = "coalesce(nullif(source_layer, ''), file_layer)"
_WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_WORDS_SQL = f"len(regexp_extract_all(content, '[^{_WS}]+'))"
_MSGS_SQL = f"""msgs AS (SELECT regen_id, {_LAYER_SQL} AS layer, i - 1 AS pos, coalesce(m.role, '?') AS role, coalesce(m.content, 'None') AS content
  FROM (SELECT *, unnest(conversations) AS m, generate_subscripts(conversations, 1) AS i FROM regen_rows))"""
_PCT_SQL = "list_sort(list(x))[CAST(round_even({q} * (count(*) - 1), 0) AS INT) + 1]"


def _regen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "regen_rows").withColumn("layer", effective_layer(F.col("source_layer"), F.col("file_layer")))


def _prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "raw_prompts").withColumn("layer", effective_layer(F.col("source_layer"), F.col("file_layer")))


@query(f"SELECT row_id, coalesce(nullif(id, ''), prompt_hash) AS profile_id, coalesce(nullif(id, ''), {_LAYER_SQL} || ':' || prompt_hash) AS composite_id, {_LAYER_SQL} AS layer, CAST(len(prompt_messages) AS INT) AS messages FROM raw_prompts")
def conv_normalised(spark, sf_dir):
    p = _prompts(spark, sf_dir)
    size = F.when(F.col("prompt_messages").isNotNull(), F.size("prompt_messages"))
    return p.select("row_id", profile.profile_id(F.col("id"), F.col("prompt_hash")).alias("profile_id"), effective_id(F.col("id"), F.col("layer"), F.col("prompt_hash")).alias("composite_id"), "layer", size.alias("messages"))


@query(f"""SELECT row_id, coalesce(nullif(id, ''), {_LAYER_SQL} || ':' || prompt_hash) AS id, coalesce({_LAYER_SQL}, '?') AS source_layer, CASE WHEN len(prompt_messages) > 0 AND coalesce(prompt_messages[1].role, '?') <> 'assistant' AND len(list_filter(prompt_messages, lambda m: coalesce(m.role, '?') NOT IN ('system', 'user', 'assistant'))) = 0 THEN 'conversations' ELSE 'prompt_messages' END AS held FROM raw_prompts""")
def conv_reshaped(spark, sf_dir):
    """Rows as they leave regeneration: the prompt's field gives way to the conversation's, id and layer are added where absent."""
    done = complete.reshaped(_prompts(spark, sf_dir), "prompt_messages", complete.regenerate(_prompts(spark, sf_dir), "row_id", "prompt_messages"), "row_id")
    held = F.when(F.col("conversations").isNotNull(), "conversations").when(F.col("status") == "error", "prompt_messages")
    return done.select("row_id", effective_id(F.col("id"), F.col("layer"), F.col("prompt_hash")).alias("id"), F.coalesce("layer", F.lit("?")).alias("source_layer"), held.alias("held"))


@query(f"""SELECT {_LAYER_SQL} AS layer, count(*) AS n_rows, count(*) FILTER (prompt_messages IS NULL) AS n_bad, count(*) FILTER (len(prompt_messages) = 0) AS empty_conv,
 count(*) FILTER (len(prompt_messages) > 0 AND coalesce(prompt_messages[1].role, '?') <> 'user') AS first_not_user FROM raw_prompts GROUP BY 1""")
def conv_counters(spark, sf_dir):
    return profile.row_counters(_prompts(spark, sf_dir), ["layer"], "prompt_messages")


@query(f"""SELECT layer, count(pid) AS ids, count(DISTINCT pid) AS distinct_ids, count(pid) - count(DISTINCT pid) AS dup_ids
 FROM (SELECT {_LAYER_SQL} AS layer, coalesce(nullif(id, ''), prompt_hash) AS pid FROM raw_prompts WHERE prompt_messages IS NOT NULL) WHERE pid IS NOT NULL GROUP BY 1""")
def conv_id_report(spark, sf_dir):
    rows = _prompts(spark, sf_dir).withColumn("pid", profile.profile_id(F.col("id"), F.col("prompt_hash")))
    return profile.id_report(rows, ["layer"], "pid", "prompt_messages")


@query(f"WITH {_MSGS_SQL} SELECT role, count(*) AS messages FROM msgs GROUP BY role")
def conv_role_counts(spark, sf_dir):
    return profile.role_counts(_regen(spark, sf_dir), "conversations")


@query("SELECT prompt_messages[1].role AS role, count(*) AS rows FROM raw_prompts WHERE len(prompt_messages) > 0 GROUP BY 1")
def conv_first_role(spark, sf_dir):
    return profile.first_roles(_prompts(spark, sf_dir), "prompt_messages")


@query(f"""SELECT layer, count(*) AS n, CAST(sum(x) AS BIGINT) AS total, min(x) AS least, max(x) AS most, {_PCT_SQL.format(q=0.5)} AS p50, {_PCT_SQL.format(q=0.9)} AS p90, {_PCT_SQL.format(q=0.99)} AS p99
 FROM (SELECT {_LAYER_SQL} AS layer, CAST(len(conversations) AS INT) AS x FROM regen_rows WHERE conversations IS NOT NULL) GROUP BY layer""")
def conv_turns(spark, sf_dir):
    return stats.nearest_rank(profile.turns(_regen(spark, sf_dir), ["layer"], "conversations"), ["layer"], "turns", profile.SHARES).drop("mean")


@query("""SELECT row_id, CAST(len(prompt_messages) AS INT) AS turns, CASE WHEN len(prompt_messages) > 0 THEN CAST(len(list_filter(prompt_messages, lambda m: m.role = 'user')) AS INT) END AS user_turns,
 CASE WHEN len(prompt_messages) > 0 THEN CAST(len(list_filter(prompt_messages, lambda m: m.role = 'assistant')) AS INT) END AS assistant_turns FROM raw_prompts WHERE prompt_messages IS NOT NULL""")
def conv_turns_per_row(spark, sf_dir):
    return profile.turns(_prompts(spark, sf_dir), ["row_id"], "prompt_messages")


def _length_sql(unit: str) -> str:
    return f"""WITH {_MSGS_SQL}, v AS (SELECT CASE WHEN role IN ('system', 'user', 'assistant') THEN role ELSE 'other' END AS bucket, CAST({unit} AS INT) AS x FROM msgs)
 SELECT bucket, count(*) AS n, CAST(sum(x) AS BIGINT) AS total, round(avg(x), 6) AS mean, min(x) AS least, max(x) AS most, {_PCT_SQL.format(q=0.5)} AS p50, {_PCT_SQL.format(q=0.9)} AS p90, {_PCT_SQL.format(q=0.99)} AS p99 FROM v GROUP BY bucket"""


@query(_length_sql("length(content)"))
def conv_length_profile(spark, sf_dir):
    return profile.length_profile(_regen(spark, sf_dir), [], "conversations", "chars").withColumn("mean", F.round("mean", 6))


@query(_length_sql(_WORDS_SQL))
def conv_word_profile(spark, sf_dir):
    return profile.length_profile(_regen(spark, sf_dir), [], "conversations", "words").withColumn("mean", F.round("mean", 6))


@query(f"""WITH {_MSGS_SQL}, w AS (SELECT *, {_WORDS_SQL} AS n FROM msgs),
 r AS (SELECT layer, regen_id, CAST(sum(n) AS INT) AS x FROM w GROUP BY ALL),
 a AS (SELECT layer, count(*) AS rows, {_PCT_SQL.format(q=0.5)} AS row_p50, {_PCT_SQL.format(q=0.9)} AS row_p90, {_PCT_SQL.format(q=0.99)} AS row_p99, max(x) AS row_max FROM r GROUP BY layer),
 u AS (SELECT layer, {_PCT_SQL.format(q=0.5)} AS user_p50, {_PCT_SQL.format(q=0.9)} AS user_p90, {_PCT_SQL.format(q=0.99)} AS user_p99 FROM (SELECT layer, CAST(n AS INT) AS x FROM w WHERE role = 'user') GROUP BY layer),
 s AS (SELECT layer, CAST(floor(avg(n)) AS BIGINT) AS sys_mean FROM w WHERE role = 'system' GROUP BY layer)
 SELECT layer, rows, row_p50, row_p90, row_p99, row_max, sys_mean, user_p50, user_p90, user_p99 FROM a LEFT JOIN s USING (layer) LEFT JOIN u USING (layer)""")
def conv_layer_summary(spark, sf_dir):
    return profile.layer_summary(_regen(spark, sf_dir), "layer", "conversations")


@query("""SELECT regen_id, CAST(len(p) AS INT) AS messages, p[len(p)].content AS last_content FROM (SELECT regen_id,
 CASE WHEN list_position(list_transform(conversations, lambda m: m.role), 'assistant') > 0 THEN conversations[1:list_position(list_transform(conversations, lambda m: m.role), 'assistant') - 1] ELSE conversations END AS p
 FROM regen_rows WHERE (status IS NULL OR status = 'success')) WHERE len(p) > 0""")
def conv_prompt_prefix(spark, sf_dir):
    rows = _regen(spark, sf_dir).where(routing.usable(F.col("status"))).select("regen_id", routing.prompt_prefix(F.col("conversations")).alias("p"))
    return rows.where(F.size("p") > 0).select("regen_id", F.size("p").alias("messages"), F.element_at("p", -1)["content"].alias("last_content"))


@query("""SELECT row_id, CASE WHEN prompt_messages IS NULL OR len(prompt_messages) = 0 THEN 'missing conversations'
  WHEN coalesce(prompt_messages[1].role, '?') = 'assistant' THEN 'conversation begins with an assistant'
  WHEN len(bad) > 0 THEN 'invalid role: ' || bad[1] END AS error, CAST(len(list_filter(prompt_messages, lambda m: m.role IN ('system', 'user'))) AS INT) AS kept
 FROM (SELECT *, list_filter(list_transform(prompt_messages, lambda m: coalesce(m.role, '?')), lambda r: r NOT IN ('system', 'user', 'assistant')) AS bad FROM raw_prompts)""")
def conv_regen_skeleton(spark, sf_dir):
    m = F.col("prompt_messages")
    kept = F.when(m.isNotNull(), F.size(routing.skeleton(m)))
    return _prompts(spark, sf_dir).select("row_id", routing.skeleton_error(m).alias("error"), kept.alias("kept"))


@query("""SELECT row_id, CASE WHEN e THEN 'error' ELSE 'success' END AS status, CASE WHEN NOT e THEN CAST(len(k) + len(u) AS INT) END AS messages,
 CASE WHEN NOT e AND len(u) > 0 AND k[len(k)].role = 'user' THEN 'answer ' || len(u) || ' to ' || length(coalesce(u[len(u)].content, '')) || ' characters' END AS last_answer
 FROM (SELECT row_id, list_filter(prompt_messages, lambda m: m.role IN ('system', 'user')) AS k, list_filter(prompt_messages, lambda m: m.role = 'user') AS u,
  (prompt_messages IS NULL OR len(prompt_messages) = 0 OR coalesce(prompt_messages[1].role, '?') = 'assistant' OR len(list_filter(prompt_messages, lambda m: coalesce(m.role, '?') NOT IN ('system', 'user', 'assistant'))) > 0) AS e FROM raw_prompts)""")
def conv_regenerate(spark, sf_dir):
    done = complete.regenerate(_prompts(spark, sf_dir), "row_id", "prompt_messages")
    last = F.try_element_at("conversations", F.lit(-1))
    ok = F.col("status") == "success"
    return done.select("row_id", "status", F.when(ok, F.size("conversations")).alias("messages"), F.when(ok & (last["role"] == "assistant"), last["content"]).alias("last_answer"))


# ---------------------------------------------------------------- splits and routes


@query(f"""WITH r AS (SELECT regen_id, {_LAYER_SQL} AS layer FROM regen_rows WHERE (status IS NULL OR status = 'success') AND len(conversations) > 0),
 k AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY md5(regen_id || ':{SEED}'), regen_id) AS rn, count(*) OVER (PARTITION BY layer) AS n FROM r)
 SELECT regen_id, layer, CASE WHEN rn <= CASE WHEN n > 1 THEN greatest(0, least(round_even(n * {EVAL_SHARE}, 0), n - 1)) ELSE 0 END THEN 'eval' ELSE 'train' END AS split FROM k""")
def split_stratified(spark, sf_dir):
    rows = _regen(spark, sf_dir).where(routing.usable(F.col("status")) & (F.size("conversations") > 0)).select("regen_id", "layer")
    return routing.stratified_split(rows, "layer", "regen_id", SEED, share=EVAL_SHARE)


@query(f"""WITH r AS (SELECT doc_id, source FROM documents), k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id || ':{SEED}'), doc_id) AS rn, count(*) OVER (PARTITION BY source) AS n FROM r)
 SELECT source, CASE WHEN rn <= least(25, n) THEN 'eval' ELSE 'train' END AS split, count(*) AS rows FROM k GROUP BY ALL""")
def split_fixed_counts(spark, sf_dir):
    return routing.stratified_split(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", SEED, fixed=25).groupBy("source", "split").agg(F.count("*").alias("rows"))


_IDS_SQL = """t AS (SELECT DISTINCT id FROM split_rows WHERE split = 'train' AND id <> ''), e AS (SELECT DISTINCT id FROM split_rows WHERE split IN ('eval', 'test') AND id <> '')"""


def _split_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "split_rows")
    return rows.where("split = 'train'"), rows.where("split IN ('eval', 'test')")


@query(f"""WITH {_IDS_SQL} SELECT regen_id, r.id, coalesce(nullif(source_layer, ''), '?') AS source_layer, 'success' AS status, CASE WHEN t.id IS NOT NULL THEN 'train' ELSE 'eval' END AS split
 FROM regen_rows r LEFT JOIN t ON r.id = t.id LEFT JOIN e ON r.id = e.id WHERE t.id IS NOT NULL OR e.id IS NOT NULL""")
def route_by_id(spark, sf_dir):
    routed = routing.route_by_id(table(spark, sf_dir, "regen_rows"), *_split_ids(spark, sf_dir)).where("split IS NOT NULL")
    return routed.select("regen_id", "id", F.coalesce(F.nullif("source_layer", F.lit("")), F.lit("?")).alias("source_layer"), F.lit("success").alias("status"), "split")


@query(f"WITH {_IDS_SQL} SELECT regen_id FROM regen_rows r WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.id = r.id) AND NOT EXISTS (SELECT 1 FROM e WHERE e.id = r.id)")
def route_dropped(spark, sf_dir):
    return routing.dropped(table(spark, sf_dir, "regen_rows"), *_split_ids(spark, sf_dir)).select("regen_id")


@query(f"""WITH {_IDS_SQL}, j AS (SELECT {_LAYER_SQL} AS layer, CASE WHEN r.id IN (SELECT id FROM t) THEN 'train' WHEN r.id IN (SELECT id FROM e) THEN 'eval' ELSE 'dropped' END AS split FROM regen_rows r)
 SELECT layer, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'eval') AS eval, count(*) FILTER (split = 'dropped') AS dropped FROM j GROUP BY layer""")
def route_counts(spark, sf_dir):
    routed = routing.route_by_id(_regen(spark, sf_dir).select("id", "layer"), *_split_ids(spark, sf_dir))
    return routed.groupBy("layer").agg(F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "eval").alias("eval"), F.count_if(F.col("split").isNull()).alias("dropped"))


@query(f"WITH {_IDS_SQL} SELECT id FROM t INTERSECT SELECT id FROM e")
def split_overlap_ids(spark, sf_dir):
    t, e = _split_ids(spark, sf_dir)
    return routing.distinct_ids(t).intersect(routing.distinct_ids(e))


@query("SELECT DISTINCT id FROM (SELECT id FROM split_rows UNION ALL SELECT id FROM regen_rows UNION ALL SELECT id FROM raw_prompts) WHERE id <> ''")
def id_union(spark, sf_dir):
    return routing.distinct_ids(*[table(spark, sf_dir, t) for t in ("split_rows", "regen_rows", "raw_prompts")])


@query("""WITH a AS (SELECT DISTINCT id FROM raw_prompts WHERE id <> ''), b AS (SELECT DISTINCT id FROM regen_rows WHERE id <> '')
 (SELECT id, 'missing' AS side FROM (SELECT id FROM a EXCEPT SELECT id FROM b)) UNION ALL (SELECT id, 'extra' AS side FROM (SELECT id FROM b EXCEPT SELECT id FROM a))""")
def id_differences(spark, sf_dir):
    a, b = routing.distinct_ids(table(spark, sf_dir, "raw_prompts")), routing.distinct_ids(table(spark, sf_dir, "regen_rows"))
    return a.exceptAll(b).withColumn("side", F.lit("missing")).unionByName(b.exceptAll(a).withColumn("side", F.lit("extra")))


@query("SELECT row_id FROM raw_prompts p WHERE NOT EXISTS (SELECT 1 FROM regen_rows r WHERE r.id = p.id AND r.id <> '' AND (r.status IS NULL OR r.status = 'success'))")
def resume_to_do(spark, sf_dir):
    return routing.to_do(table(spark, sf_dir, "raw_prompts"), table(spark, sf_dir, "regen_rows")).select("row_id")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY split_row_id) AS rn FROM split_rows)
 SELECT split, split_row_id, array_to_string(list_transform(conversations, lambda m: coalesce(m.role, '?') || ': ' || coalesce(CASE WHEN length(m.content) > 200 THEN substr(m.content, 1, 200) || '...' ELSE m.content END, '')), chr(10)) AS preview FROM r WHERE rn <= 2""")
def split_previews(spark, sf_dir):
    return routing.previews(table(spark, sf_dir, "split_rows"), "split", "split_row_id", "conversations")


@query("SELECT status, count(*) AS rows FROM (SELECT CASE WHEN status IS NULL OR status = 'success' THEN 'usable' ELSE 'failed' END AS status FROM regen_rows) GROUP BY 1")
def route_status(spark, sf_dir):
    return table(spark, sf_dir, "regen_rows").groupBy(F.when(routing.usable(F.col("status")), "usable").otherwise("failed").alias("status")).agg(F.count("*").alias("rows"))


# ---------------------------------------------------------------- files


def _jsonl_copy(spark, sf_dir):
    """The prompts as JSON Lines in the shared folder, one folder per layer."""
    path = written(f"{shared_dir(spark)}/loom-{uuid.uuid4().hex}")
    rows = _prompts(spark, sf_dir).select("row_id", "user_id", "prompt_hash", "id", "source_layer", "prompt_messages", F.col("layer").alias("part"))
    jsonl.write(rows, path, by="part")
    return path


@query(f"""SELECT {_LAYER_SQL} AS layer, count(*) AS rows, count(*) FILTER (coalesce(len(prompt_messages), 0) = 0) AS malformed, count(DISTINCT id) FILTER (id <> '') AS ids, CAST(coalesce(sum(len(prompt_messages)), 0) AS BIGINT) AS messages,
 CAST(sum(list_sum(list_transform(prompt_messages, lambda m: length(m.content)))) AS BIGINT) AS chars FROM raw_prompts GROUP BY 1""")
def jsonl_round_trip(spark, sf_dir):
    """An empty first list falls through to lists that aren't there, so a row without messages is malformed in a file."""
    lines = spark.read.text(f"{_jsonl_copy(spark, sf_dir)}/part=*").select(F.col("value").alias("line"), F.regexp_extract("_metadata.file_path", "/part=([^/]+)/", 1).alias("file_layer"), F.col("_metadata.file_name").alias("file"))
    r = jsonl.parse(lines)
    chars = F.aggregate("messages", F.lit(0).cast("bigint"), lambda a, m: a + F.coalesce(F.length(m["content"]), F.lit(0)))
    return r.groupBy(F.col("file_layer").alias("layer")).agg(
        F.count("*").alias("rows"), F.count_if("malformed").alias("malformed"), F.count_distinct(F.nullif("id", F.lit(""))).alias("ids"), F.coalesce(F.sum(F.size("messages")), F.lit(0)).alias("messages"), F.sum(F.when(F.size("messages") > 0, chars)).alias("chars")
    )


@query("SELECT count(*) AS lines FROM raw_prompts")
def jsonl_line_count(spark, sf_dir):
    return spark.read.text(f"{_jsonl_copy(spark, sf_dir)}/part=*").agg(F.count("*").alias("lines"))


def _folder(spark):
    """A new folder beside the written tables, for files with names of their own."""
    return written(f"{shared_dir(spark)}/loom-{uuid.uuid4().hex}")


@query(f"SELECT {_LAYER_SQL} AS layer, count(*) AS rows, count(*) FILTER (status = 'error') AS failed FROM regen_rows GROUP BY 1")
def jsonl_layer_of_file(spark, sf_dir):
    """A folder of files named by layer, written and read again; the layer is the file's name."""
    folder = _folder(spark)
    jsonl.write_files(_regen(spark, sf_dir).select("regen_id", "id", "status", "conversations", "layer"), folder, "layer", "{}_regen.jsonl", parts=2)
    rows = jsonl.parse(jsonl.read_lines(spark, folder, "*_regen*.jsonl"))
    return rows.groupBy(F.col("file_layer").alias("layer")).agg(F.count("*").alias("rows"), F.count_if(F.col("status") == "error").alias("failed"))


@query("""SELECT CASE split WHEN 'train' THEN 'train' ELSE 'eval' END AS split, coalesce(nullif(source_layer, '?'), 'layer0') AS layer, count(*) AS rows, count(DISTINCT id) FILTER (id <> '') AS ids FROM split_rows WHERE split IN ('train', 'eval') GROUP BY 1, 2""")
def split_files(spark, sf_dir):
    """The files of a split folder: a file of training rows per layer, and one of held-out rows per layer below it."""
    folder = _folder(spark)
    rows = table(spark, sf_dir, "split_rows").select("id", "split", "status", "conversations", F.coalesce(F.nullif("source_layer", F.lit("?")), F.lit("layer0")).alias("source_layer")).withColumn("layer", F.col("source_layer"))
    jsonl.write_files(rows.where("split = 'train'").drop("split"), folder, "layer", "train_{}.jsonl")
    jsonl.write_files(rows.where("split = 'eval'").drop("split"), f"{folder}/eval_datasets", "layer")
    lines = jsonl.read_split_files(spark, folder)
    both = jsonl.parse(lines.where("split = 'train'")).withColumn("split", F.lit("train")).unionByName(jsonl.parse(lines.where("split = 'eval'")).withColumn("split", F.lit("eval")))
    return both.groupBy("split", F.col("file_layer").alias("layer")).agg(F.count("*").alias("rows"), F.count_distinct(F.nullif("id", F.lit(""))).alias("ids"))


@query(f"""WITH l AS (SELECT {_LAYER_SQL} AS layer, count(*) AS rows, count(*) FILTER (prompt_messages IS NULL OR len(prompt_messages) = 0) AS empty FROM raw_prompts GROUP BY 1)
 SELECT layer, 'ran' AS said, rows, empty FROM l UNION ALL SELECT 'layer0_missing', 'no input file', NULL, NULL""")
def layer_loop(spark, sf_dir):
    """Each layer's prompts as a file, regenerated one after another; a layer without a file is skipped."""
    source, out, final = _folder(spark), _folder(spark), _folder(spark)
    jsonl.write_files(_prompts(spark, sf_dir).select("row_id", "id", "prompt_hash", "prompt_messages", "layer"), source, "layer")
    layers = sorted(r["layer"] for r in _prompts(spark, sf_dir).select("layer").distinct().collect())  # the values that name files

    def run(lines, layer):
        rows = jsonl.parse(lines).withColumn("n", F.monotonically_increasing_id())
        return complete.regenerate(rows, "n", "messages").select("conversations", "status", "error")

    said = stages.run_layers(spark, source, out, run, [*layers, "layer0_missing"], final)
    done = jsonl.parse(jsonl.read_lines(spark, final, "*_regen.jsonl"))
    counts = done.groupBy(F.col("file_layer").alias("layer")).agg(F.count("*").alias("rows"), F.count_if(F.col("error") == "missing conversations").alias("empty"))
    return spark.createDataFrame(list(said.items()), "layer string, said string").join(counts, "layer", "left")


@query("""SELECT event_id, k.unnest AS key, coalesce(json_extract_string(props, '$.' || k.unnest), '(absent)') AS value FROM events, unnest(['k', 'missing']) AS k""")
def config_values(spark, sf_dir):
    return jsonl.config_values(table(spark, sf_dir, "events").select("event_id", "props"), "props", ["k", "missing"])


@query("SELECT status, count(*) AS rows FROM (SELECT CASE WHEN (status IS NULL OR status = 'success') AND conversations IS NOT NULL THEN 'good' ELSE 'bad' END AS status FROM regen_rows) GROUP BY 1")
def stream_routes(spark, sf_dir):
    """A streaming query over JSON Lines files, run until nothing is left."""
    from loomspark.streaming.ingest import route_by_status, stream_records

    base = written(f"{shared_dir(spark)}/loom-{uuid.uuid4().hex}")
    jsonl.write(table(spark, sf_dir, "regen_rows").select("id", "source_layer", "status", "error", "conversations"), f"{base}/in")
    route_by_status(stream_records(spark, f"{base}/in"), f"{base}/good", f"{base}/bad", f"{base}/checkpoint").awaitTermination()
    parts = [spark.read.parquet(f"{base}/{s}").select(F.lit(s).alias("status")) for s in ("good", "bad")]
    return parts[0].unionByName(parts[1]).groupBy("status").agg(F.count("*").alias("rows"))


# ---------------------------------------------------------------- token samples

_RENDER_SQL = """rendered AS (SELECT regen_id, array_to_string(list_transform(conversations, lambda m: '<|turn>' || CASE m.role WHEN 'user' THEN 'user' WHEN 'assistant' THEN 'model' WHEN 'system' THEN 'system' END || chr(10) ||
   CASE WHEN m.role = 'assistant' AND NOT starts_with(m.content, '<|channel>thought' || chr(10) || '<channel|>') THEN '<|channel>thought' || chr(10) || '<channel|>' || m.content WHEN m.role = 'assistant' THEN m.content ELSE coalesce(m.content, '') END || '<turn|>' || chr(10)), '') AS text
  FROM regen_rows WHERE (status IS NULL OR status = 'success') AND len(conversations) > 0
   AND len(list_filter(conversations, lambda m: m.role IS NULL OR m.role NOT IN ('system', 'user', 'assistant') OR (m.role = 'assistant' AND m.content IS NULL))) = 0)"""


def _usable(spark, sf_dir):
    return _regen(spark, sf_dir).where(routing.usable(F.col("status")) & (F.size("conversations") > 0))


@query(f"WITH {_RENDER_SQL} SELECT regen_id, text FROM rendered")
def render_text(spark, sf_dir):
    return _usable(spark, sf_dir).select("regen_id", tx.render(F.col("conversations")).alias("text")).where("text IS NOT NULL")


@query(f"""WITH {_RENDER_SQL}, s AS (SELECT regen_id, string_split(text, '<|turn>model' || chr(10)) AS p FROM rendered)
 SELECT regen_id, list_transform(p[2:], lambda x: CASE WHEN starts_with(x, '<|channel>thought' || chr(10) || '<channel|>') THEN substr(t(x), 29) ELSE t(x) END) AS spans FROM s""".replace("t(x)", "(CASE WHEN contains(x, '<turn|>' || chr(10)) THEN substr(x, 1, instr(x, '<turn|>' || chr(10)) + 7) ELSE x END)"))
def assistant_spans(spark, sf_dir):
    """Of all usable rows, also those whose contents hold an end-of-turn marker: it ends the span."""
    rows = _usable(spark, sf_dir)
    return rows.select("regen_id", tx.render(F.col("conversations")).alias("t")).where("t IS NOT NULL").select("regen_id", tx.assistant_spans(F.col("t")).alias("spans"))


def _samples(spark, sf_dir, max_length: int = 4096):
    return anchors.tokenised(_usable(spark, sf_dir), "regen_id", "conversations", max_length)


def _samples_sql() -> str:
    w = f"regexp_extract_all(p, '[^{_WS}]+')"
    ids = f"list_transform({w}, lambda t: CAST('0x' || substr(md5(t), 1, 7) AS INT))"
    return f"""{_RENDER_SQL}, cut AS (SELECT regen_id, string_split(regexp_replace(text, '(<\\|turn>model\\n(?:<\\|channel>thought\\n<channel\\|>)?)((?s:.)*?(?:<turn\\|>\\n|\\z))', '\\1' || chr(1) || '\\2' || chr(1), 'g'), chr(1)) AS pieces FROM rendered WHERE text <> ''),
 tok AS (SELECT regen_id, flatten(list_transform(pieces, lambda p: {ids})) AS ids, flatten(list_transform(pieces, lambda p, i: list_transform({w}, lambda t: CAST((i - 1) % 2 AS INT)))) AS mask FROM cut),
 samples AS (SELECT regen_id, ids[1:4096] AS input_ids, mask[1:4096] AS loss_mask FROM tok)"""


@query(f"WITH {_samples_sql()} SELECT regen_id, CAST(len(input_ids) AS INT) AS tokens, CAST(list_sum(list_transform(input_ids, lambda x: CAST(x AS BIGINT))) AS BIGINT) AS id_sum, CAST(coalesce(list_sum(loss_mask), 0) AS INT) AS supervised FROM samples")
def loss_mask_tokens(spark, sf_dir):
    total = F.aggregate("input_ids", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return _samples(spark, sf_dir).select("regen_id", F.size("input_ids").alias("tokens"), total.alias("id_sum"), anchors.supervised(F.col("loss_mask").cast("array<int>")).alias("supervised"))


@query(f"WITH {_samples_sql()} SELECT regen_id, list_sum(loss_mask) / len(loss_mask) AS share FROM samples WHERE list_sum(loss_mask) > 0")
def supervised_fraction(spark, sf_dir):
    n = anchors.supervised(F.col("loss_mask").cast("array<int>"))
    return _samples(spark, sf_dir).where(n > 0).select("regen_id", (n / F.size("loss_mask")).alias("share"))


def _masks(spark, sf_dir):
    return _samples(spark, sf_dir).select("regen_id", F.col("loss_mask").cast("array<int>").alias("mask"))


_VALID_SQL = "valid AS (SELECT regen_id, loss_mask AS mask, list_filter(range(0, len(loss_mask) - 1), lambda t: loss_mask[t + 1] = 1 AND loss_mask[t + 2] = 1) AS v FROM samples)"


@query(f"WITH {_samples_sql()}, {_VALID_SQL} SELECT regen_id, CAST(len(v) AS INT) AS anchors, CAST(v[1] AS INT) AS first_anchor FROM valid")
def anchor_valid(spark, sf_dir):
    return _masks(spark, sf_dir).withColumn("v", anchors.valid_anchors(F.col("mask"))).select("regen_id", F.size("v").alias("anchors"), F.get("v", 0).alias("first_anchor"))


@query(f"""WITH {_samples_sql()}, {_VALID_SQL}, s AS (SELECT regen_id, list_transform(list_sort(list_transform(v, lambda t: {{'k': md5(regen_id || ':' || t || ':{SEED}'), 't': CAST(t AS INT)}}))[1:8], lambda x: x.t) AS a FROM valid)
 SELECT regen_id, list_concat(a, list_transform(range(0, 8 - len(a)), lambda i: CAST(0 AS INT))) AS anchors, list_concat(list_transform(a, lambda x: true), list_transform(range(0, 8 - len(a)), lambda i: false)) AS keep_mask FROM s""")
def anchor_sample(spark, sf_dir):
    return anchors.sampled_anchors(_masks(spark, sf_dir), "regen_id", "mask", 8, SEED)


@query(f"""WITH {_samples_sql()}, {_VALID_SQL}, p AS (SELECT CAST(unnest(v) AS INT) AS t FROM valid)
 SELECT count(*) AS n, min(t) AS least, max(t) AS most, CAST(floor(quantile_cont(t, 0.5)) AS BIGINT) AS p50, CAST(floor(quantile_cont(t, 0.9)) AS BIGINT) AS p90, CAST(floor(quantile_cont(t, 0.99)) AS BIGINT) AS p99, round(avg(CASE WHEN t > 64 THEN 1.0 ELSE 0.0 END), 6) AS beyond_window,
  CASE WHEN avg(CASE WHEN t > 64 THEN 1.0 ELSE 0.0 END) > 0.05 THEN 'window matters' ELSE 'window negligible' END AS verdict FROM p""")
def anchor_coverage(spark, sf_dir):
    t = _masks(spark, sf_dir).select(F.explode(anchors.valid_anchors(F.col("mask"))).alias("t"))
    beyond = F.avg((F.col("t") > 64).cast("double"))
    shares = {"p50": 0.5, "p90": 0.9, "p99": 0.99}
    one = t.agg(F.count("t").alias("n"), F.min("t").alias("least"), F.max("t").alias("most"), *[F.percentile("t", F.lit(q)).cast("bigint").alias(k) for k, q in shares.items()], beyond.alias("b"))
    return one.select("n", "least", "most", *shares, F.round("b", 6).alias("beyond_window"), F.when(F.col("b") > 0.05, "window matters").otherwise("window negligible").alias("verdict"))


@query(f"""WITH {_samples_sql()}, {_VALID_SQL}, k AS (SELECT unnest(range(0, 5)) AS step), a AS (SELECT mask, unnest(v) AS t FROM valid),
 n AS (SELECT step, count(*) AS n FROM a, k WHERE mask[t + step + 2] = 1 GROUP BY step)
 SELECT CAST(step AS INT) AS step, n, round(exp(-step / 4.0), 9) AS weight, round(greatest(sum(exp(-step / 4.0) * n) OVER (), 1), 3) AS denominator FROM n""")
def step_denominator(spark, sf_dir):
    n = anchors.supervised_steps(_masks(spark, sf_dir), "regen_id", "mask", 5)
    weights = F.create_map(*[F.lit(x) for kv in enumerate(vx.step_weights(5, 4.0)) for x in kv])
    w = weights[F.col("step")]
    return n.select("step", "n", F.round(w, 9).alias("weight"), F.round(F.greatest(F.sum(w * F.col("n")).over(Window.partitionBy()), F.lit(1.0)), 3).alias("denominator"))


# ---------------------------------------------------------------- sample cache


@query(f"""WITH u AS (SELECT regen_id, row_number() OVER (ORDER BY regen_id) - 1 AS ordinal, count(*) OVER () AS n FROM regen_rows WHERE (status IS NULL OR status = 'success') AND len(conversations) > 0)
 SELECT regen_id, ordinal, CAST(ordinal % 4 AS INT) AS modulo_rank, CAST(ntile(4) OVER (ORDER BY ordinal) - 1 AS INT) AS range_rank,
 CASE WHEN ordinal < (n // 4) * 4 THEN CAST((ordinal // (n // 4) - 1 + 4) % 4 AS INT) END AS rotating_rank FROM u""")
def shard_ranks(spark, sf_dir):
    u = materialize(cache.dense_ordinal(_usable(spark, sf_dir).select("regen_id"), ["regen_id"], "ordinal"))
    n = u.agg(F.count("*").alias("n"))
    o, total = F.col("ordinal"), F.col("n")
    r = u.crossJoin(F.broadcast(n))  # one row
    return r.select("regen_id", "ordinal", cache.modulo_rank(o, 4).alias("modulo_rank"), cache.contiguous_rank(o, total, 4).alias("range_rank"), cache.rotating_rank(o, total, 4, 1).alias("rotating_rank"))


_BYTES = 5 + 2 * cache.HIDDEN + sum(2 * h * d for h, d in cache.KV.values())


@query(f"""SELECT sample_id, CAST(seq_len AS BIGINT) * 4 AS input_ids, CAST(seq_len AS BIGINT) AS loss_mask, CAST(seq_len AS BIGINT) * {2 * cache.HIDDEN} AS last_hidden, {", ".join(f"CAST(seq_len AS BIGINT) * {2 * h * d} AS {k}" for k, (h, d) in cache.KV.items())}, CAST(seq_len AS BIGINT) * {_BYTES} AS nbytes FROM sample_index""")
def cache_nbytes(spark, sf_dir):
    s = table(spark, sf_dir, "sample_index")
    return s.select("sample_id", *[c.alias(k) for k, c in cache.field_bytes(F.col("seq_len")).items()], cache.sample_bytes(F.col("seq_len")).alias("nbytes"))


LIMIT = 256 * 1024**2


def _rolled(spark, sf_dir):
    s = table(spark, sf_dir, "sample_index").select(F.pmod("sample_id", F.lit(3)).cast("int").alias("writer"), F.col("sample_id").alias("ordinal"), cache.sample_bytes(F.col("seq_len")).alias("nbytes"))
    return cache.roll_shards(s, LIMIT)


_ROLL_SQL = f"""s AS (SELECT CAST(sample_id % 3 AS INT) AS writer, sample_id AS ordinal, seq_len, CAST(seq_len AS BIGINT) * {_BYTES} AS nbytes, row_number() OVER (PARTITION BY sample_id % 3 ORDER BY sample_id) AS i FROM sample_index),
 roll AS (SELECT writer, ordinal, seq_len, nbytes, i, 0 AS local_shard, CAST(0 AS BIGINT) AS shard_offset FROM s WHERE i = 1 UNION ALL
  SELECT s.writer, s.ordinal, s.seq_len, s.nbytes, s.i, CASE WHEN r.shard_offset + r.nbytes + s.nbytes > {LIMIT} THEN r.local_shard + 1 ELSE r.local_shard END, CASE WHEN r.shard_offset + r.nbytes + s.nbytes > {LIMIT} THEN 0 ELSE r.shard_offset + r.nbytes END
  FROM roll r JOIN s ON s.writer = r.writer AND s.i = r.i + 1)"""
_GLOBAL_SQL = """g AS (SELECT writer, local_shard, CAST(row_number() OVER (ORDER BY src, local_shard) - 1 AS INT) AS shard_id FROM (SELECT DISTINCT writer, local_shard, min(ordinal) OVER (PARTITION BY writer) AS src FROM roll))"""


@query(f"WITH RECURSIVE {_ROLL_SQL} SELECT writer, ordinal, nbytes, local_shard, shard_offset FROM roll")
def cache_shards(spark, sf_dir):
    return _rolled(spark, sf_dir)


@query(f"WITH RECURSIVE {_ROLL_SQL}, {_GLOBAL_SQL} SELECT writer, local_shard, shard_id FROM g")
def cache_global_shards(spark, sf_dir):
    return cache.global_shards(_rolled(spark, sf_dir))


def _index(spark, sf_dir):
    tokens = table(spark, sf_dir, "sample_index").select(F.col("sample_id").alias("ordinal"), "seq_len")
    return cache.merged_index(materialize(_rolled(spark, sf_dir)), tokens)


def _offsets_sql() -> str:
    out, before = [], "shard_offset"
    sizes = [4, 1, 2 * cache.HIDDEN, *[2 * h * d for h, d in cache.KV.values()]]
    total = 0
    for name, size in zip(cache.FIELDS, sizes):
        out.append(f"{before} + CAST(seq_len AS BIGINT) * {total} AS off_{name}")
        total += size
    return ", ".join(out)


@query(f"""WITH RECURSIVE {_ROLL_SQL}, {_GLOBAL_SQL}, m AS (SELECT roll.*, g.shard_id, min(ordinal) OVER (PARTITION BY roll.writer) AS src FROM roll JOIN g USING (writer, local_shard))
 SELECT row_number() OVER (ORDER BY src, ordinal) - 1 AS sample_id, shard_id, seq_len, {_offsets_sql()}, ordinal FROM m""")
def cache_index(spark, sf_dir):
    return _index(spark, sf_dir)


@query(f"WITH RECURSIVE {_ROLL_SQL}, {_GLOBAL_SQL} SELECT {cache.VERSION} AS version, (SELECT count(*) FROM roll) AS num_samples, CAST(max(shard_id) + 1 AS INT) AS num_shards, {cache.INDEX_RECORD} AS index_record_size, {cache.HIDDEN} AS hidden_size, 'shard-' || lpad(CAST(max(shard_id) AS VARCHAR), 5, '0') || '.bin' AS last_file FROM g")
def cache_manifest(spark, sf_dir):
    m = cache.manifest(_index(spark, sf_dir))
    return m.select("version", "num_samples", "num_shards", "index_record_size", "hidden_size", F.element_at("shards", -1)["file_name"].alias("last_file"))


@query("""WITH o AS (SELECT count(*) = max(sample_id) - min(sample_id) + 1 AS dense_samples, min(sample_id) = 0 AS samples_from_0, count(sample_id) = count(DISTINCT sample_id) AS unique_samples, count(DISTINCT shard_id) = max(shard_id) + 1 AS dense_shards,
  bool_and(seq_len > 0) AS positive_lengths, bool_and(off_loss_mask - off_input_ids = CAST(seq_len AS BIGINT) * 4 AND off_last_hidden - off_loss_mask = seq_len) AS offsets_follow_fields FROM sample_index)
 SELECT name AS check_name, value AS ok FROM (UNPIVOT o ON COLUMNS(*))""")
def cache_checks(spark, sf_dir):
    return cache.index_checks(table(spark, sf_dir, "sample_index"))


@query(f"WITH RECURSIVE {_ROLL_SQL}, {_GLOBAL_SQL} SELECT shard_id, 'shard-' || lpad(CAST(shard_id AS VARCHAR), 5, '0') || '.bin' AS file_name FROM g WHERE shard_id % 3 = 1")
def cache_missing_shards(spark, sf_dir):
    """Shards of the manifest without a file, in a listing that lacks every third."""
    m = materialize(cache.manifest(_index(spark, sf_dir)))
    listed = m.select(F.explode("shards.file_name").alias("file_name")).where(F.substring("file_name", 7, 5).cast("int") % 3 != 1)
    return cache.missing_shards(m, listed)


@query(f"""WITH RECURSIVE {_ROLL_SQL}, {_GLOBAL_SQL}, tops AS (SELECT max(shard_id) AS top, count(*) AS shards FROM g)
 SELECT unnest(['version', 'record_size', 'index_exists', 'index_bytes', 'shards_in_a_row', 'shard_files', 'num_samples']) AS check_name,
  unnest([true, true, (SELECT count(*) FROM roll) > 0, (SELECT count(*) FROM sample_index) = (SELECT count(*) FROM roll), top + 1 = shards, false, (SELECT count(DISTINCT sample_id) FROM sample_index) = (SELECT count(*) FROM roll)]) AS ok FROM tops""")
def cache_manifest_checks(spark, sf_dir):
    """The checks of a manifest against the index as bytes and a listing that lacks the last shard's file."""
    index = materialize(_index(spark, sf_dir))
    m = cache.manifest(index)
    listed = index.select("shard_id").distinct().where(F.col("shard_id") != index.agg(F.max("shard_id")).first()[0]).select(F.format_string(cache.SHARD_NAME, "shard_id").alias("file_name"))
    return cache.manifest_checks(m, cache.index_records(index), listed)


@query("SELECT sample_id, shard_id, seq_len, off_input_ids, off_loss_mask, off_last_hidden, off_kv_full_k, off_kv_full_v, off_kv_slide_k, off_kv_slide_v FROM sample_index")
def cache_index_bytes(spark, sf_dir):
    """The index as records of 72 bytes, and back."""
    return cache.decoded_index(cache.index_records(table(spark, sf_dir, "sample_index")))


@query("SELECT shard_id, count(*) AS samples, CAST(sum(seq_len) AS BIGINT) AS tokens FROM sample_index WHERE sample_id BETWEEN 100 AND 399 GROUP BY shard_id")
def cache_range_read(spark, sf_dir):
    """A range of ordinals: the filter is pushed to the files."""
    return table(spark, sf_dir, "sample_index").where("sample_id BETWEEN 100 AND 399").groupBy("shard_id").agg(F.count("*").alias("samples"), F.sum(F.col("seq_len").cast("bigint")).alias("tokens"))


@query("SELECT i.doc_id, s.sample_id, s.shard_id, s.seq_len, s.off_input_ids FROM documents i JOIN sample_index s ON s.sample_id = i.doc_id * 7")
def cache_point_reads(spark, sf_dir):
    """Single samples, by a list of ordinals."""
    asked = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") * 7).alias("sample_id"))
    return cache.looked_up(table(spark, sf_dir, "sample_index"), asked).select("doc_id", "sample_id", "shard_id", "seq_len", "off_input_ids")


@query("SELECT count(*) AS rows, CAST(sum(seq_len) AS BIGINT) AS tokens FROM sample_index")
def cache_written(spark, sf_dir):
    """Samples written, counted while written and read back."""
    path = _folder(spark)
    write_counted(table(spark, sf_dir, "sample_index"), path)
    return spark.read.parquet(path).agg(F.count("*").alias("rows"), F.sum(F.col("seq_len").cast("bigint")).alias("tokens"))


@query("""WITH u AS (SELECT regen_id, row_number() OVER (ORDER BY regen_id) - 1 AS ordinal FROM regen_rows WHERE (status IS NULL OR status = 'success') AND len(conversations) > 0)
 SELECT CAST(ordinal % 4 AS INT) AS modulo_rank, count(*) AS rows, max(ordinal) AS last FROM u WHERE ordinal < 500 GROUP BY 1""")
def shard_ranks_limited(spark, sf_dir):
    """A limit on the usable rows holds before they are dealt to ranks: it is the feature here."""
    u = cache.limited(cache.dense_ordinal(_usable(spark, sf_dir).select("regen_id"), ["regen_id"], "ordinal"), "ordinal", 500)
    return u.groupBy(cache.modulo_rank(F.col("ordinal"), 4).alias("modulo_rank")).agg(F.count("*").alias("rows"), F.max("ordinal").alias("last"))


@query(f"WITH {_samples_sql()}, {_VALID_SQL}, a AS (SELECT regen_id, list_filter(v[3:], lambda t: t < len(mask) - 1 - 5) AS a FROM valid) SELECT regen_id, CAST(len(a) AS INT) AS anchors, CAST(a[1] AS INT) AS first_anchor, CAST(a[len(a)] AS INT) AS last_anchor FROM a")
def anchor_positions(spark, sf_dir):
    """Anchors after the first two that leave five steps and one more place."""
    a = _masks(spark, sf_dir).withColumn("a", anchors.anchors_for(F.col("mask"), 2, 5))
    return a.select("regen_id", F.size("a").alias("anchors"), F.get("a", 0).alias("first_anchor"), F.try_element_at("a", F.lit(-1)).alias("last_anchor"))


@query(f"SELECT shard_id, count(*) AS samples, CAST(sum(seq_len) AS BIGINT) AS tokens, CAST(sum(CAST(seq_len AS BIGINT) * {_BYTES}) AS BIGINT) AS nbytes FROM sample_index GROUP BY shard_id")
def cache_shard_totals(spark, sf_dir):
    return cache.shard_totals(table(spark, sf_dir, "sample_index"))


@query("SELECT sample_id, shard_id, seq_len, off_input_ids FROM sample_index WHERE sample_id % greatest(1, (SELECT count(*) FROM sample_index) // 10) = 0 ORDER BY sample_id LIMIT 10")
def cache_spot_reads(spark, sf_dir):
    """Ten evenly spaced samples, as a reader would look them up."""
    s = table(spark, sf_dir, "sample_index")
    stride = s.agg(F.greatest(F.lit(1).cast("bigint"), F.floor(F.count("*") / 10)).alias("stride"))
    return s.crossJoin(F.broadcast(stride)).where(F.pmod("sample_id", "stride") == 0).select("sample_id", "shard_id", "seq_len", "off_input_ids").orderBy("sample_id").limit(10)


@query(f"""WITH {_samples_sql()}, b AS (SELECT regen_id, regen_id // 8 AS batch, input_ids, loss_mask FROM samples), w AS (SELECT *, max(len(input_ids)) OVER (PARTITION BY batch) AS longest FROM b)
 SELECT regen_id, batch, CAST(longest AS INT) AS padded_length, CAST(longest - len(input_ids) AS INT) AS pads, CAST(list_sum(loss_mask) AS INT) AS supervised FROM w""")
def batch_pad(spark, sf_dir):
    b = _samples(spark, sf_dir).select("regen_id", F.floor(F.col("regen_id") / 8).alias("batch"), "input_ids", F.col("loss_mask").cast("array<int>").alias("loss_mask"))
    p = cache.padded_batches(b, "batch", {"input_ids": -1, "loss_mask": 0})
    return p.select("regen_id", "batch", F.size("input_ids").alias("padded_length"), F.size(F.filter("input_ids", lambda x: x == -1)).alias("pads"), anchors.supervised(F.col("loss_mask")).alias("supervised"))


@query()
def shuffle_buffered(spark, sf_dir):
    """Held against its properties: the same rows, and none leaves ``buffer`` or more places early."""
    return cache.buffered_shuffle(table(spark, sf_dir, "sample_index").select("sample_id", "seq_len"), ["sample_id"], 64, SEED)


@query(f"SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || ':1'), doc_id) - 1 AS place FROM documents")
def shuffle_epoch(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", tx.shuffle_key(F.col("doc_id"), 1).alias("k"))
    return cache.dense_ordinal(d, ["k", "doc_id"], "place").select("doc_id", "place")


@query("""WITH f AS (SELECT label, embedding, list_position(embedding, list_max(embedding)) AS t0, list_position(embedding[2:], list_max(embedding[2:])) AS t1, round(sqrt(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * v))), 3) AS n FROM embeddings)
 SELECT count(DISTINCT label) AS ids, count(DISTINCT n) AS norms, count(DISTINCT t0) AS tops, count(DISTINCT t1) AS next_tops, CASE WHEN count(DISTINCT label) > 1 AND count(DISTINCT n) = 1 THEN 'reads are broken' WHEN count(DISTINCT n) > 1 AND count(DISTINCT t0) = 1 THEN 'argmax is broken' WHEN count(DISTINCT n) > 1 AND count(DISTINCT t0) > 1 THEN 'fine' ELSE 'inconclusive' END AS verdict FROM f""")
def cache_sanity(spark, sf_dir):
    e = vx.doubles(F.col("embedding"))
    f = table(spark, sf_dir, "embeddings").select("label", F.round(vx.norm(e), 3).alias("n"), vx.argmax(e).alias("t0"), vx.argmax(F.slice(e, 2, 1 << 30)).alias("t1"))
    c = f.agg(F.count_distinct("label").alias("ids"), F.count_distinct("n").alias("norms"), F.count_distinct("t0").alias("tops"), F.count_distinct("t1").alias("next_tops"))
    verdict = F.when((F.col("ids") > 1) & (F.col("norms") == 1), "reads are broken").when((F.col("norms") > 1) & (F.col("tops") == 1), "argmax is broken").when((F.col("norms") > 1) & (F.col("tops") > 1), "fine").otherwise("inconclusive")
    return c.withColumn("verdict", verdict)
