"""Micro-fixtures of the conversation, cache, anchor and acceptance operators."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.functions import stats, text as tx, vectors as vx
from loomspark.functions.messages import first_content, last_content
from loomspark.operators import accept, anchors, cache, complete, payload, profile, routing
from loomspark.operators.nearest import nearest_by_cosine
from loomspark.plans.stages import Stage, run_layers, run_stages
from loomspark.runtime import write_counted
from loomspark.sources import jsonl
from loomspark.streaming.ingest import route_by_status, stream_records

MSG = "array<struct<role:string,content:string>>"


def one(spark, value, schema, expr):
    return spark.createDataFrame([(value,)], f"x {schema}").select(expr(F.col("x")).alias("y")).first()["y"]


# ---------------------------------------------------------------- reading


def lines(tmp_path, rows, name="layer1_x_regen.jsonl"):
    (tmp_path / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in rows) + "\n", encoding="utf-8")
    return str(tmp_path)


def test_tolerant_reading(spark, tmp_path):
    user = {"role": "user", "content": "hé"}
    rows = ["", {"id": "a", "prompt_messages": [user]}, '{"id":"b","conv', "[1, 2]", "3", {"prompt_messages": [], "conversations": [user, user]}, {"messages": []}, {"conversations": "str"}, {"id": "", "prompt_hash": "h", "messages": [user]}]
    got = {tuple(r)[0]: r for r in jsonl.parse(jsonl.read_lines(spark, lines(tmp_path, rows))).select(F.monotonically_increasing_id(), "*").collect()}
    got = list(got.values())
    assert len(got) == 8 and all(r["file_layer"] == "layer1_x" for r in got)
    assert [r["malformed"] for r in got] == [False, True, True, True, False, False, True, False]
    assert len(got[4]["messages"]) == 2 and got[5]["messages"] == [] and got[7]["id"] == "" and got[7]["has_id"] and not got[4]["has_id"]
    assert got[0]["messages"][0]["content"] == "hé"


def test_strict_reading_fails(spark, tmp_path):
    with pytest.raises(Exception):
        jsonl.parse(jsonl.read_lines(spark, lines(tmp_path, ["{bad"])), strict=True).collect()


def test_split_files_ids_caps_and_counts(spark, tmp_path):
    lines(tmp_path, [{"id": "a"}, {"id": "b"}, {"id": None}], "train_layer1.jsonl")
    (tmp_path / "eval_datasets").mkdir()
    lines(tmp_path / "eval_datasets", [{"id": "a"}, {"id": ""}], "e.jsonl")
    files = jsonl.read_split_files(spark, str(tmp_path))
    assert {r["split"]: r["count"] for r in files.groupBy("split").count().collect()} == {"train": 3, "eval": 2}
    parsed = jsonl.parse(files)
    assert {r["id"] for r in jsonl.ids(parsed).collect()} == {"a", "b"}
    assert jsonl.capped(parsed.withColumn("k", F.monotonically_increasing_id()), 1, "k").count() == 2
    assert jsonl.count_lines(spark, str(tmp_path / "train_layer1.jsonl")) == 3


def test_writing_keeps_characters_and_refuses_to_overwrite(spark, tmp_path):
    df = spark.createDataFrame([("ü", "a"), ("x", "b")], "t string, part string")
    out = str(tmp_path / "o")
    jsonl.write(df, out, by="part")
    assert "ü" in "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "o").rglob("part-*"))
    with pytest.raises(Exception):
        jsonl.write(df, out, by="part")
    jsonl.write(df.where("part = 'a'").withColumn("t", F.lit("new")), out, by="part", overwrite_parts=True)
    assert {r["t"] for r in spark.read.json(out).collect()} == {"new", "x"}


def test_config_values(spark):
    docs = spark.createDataFrame([(1, '{"a": 1, "text_config": {"b": 2}}'), (2, '{"a": 1}')], "i long, t string")
    got = {(r["i"], r["key"]): r["value"] for r in jsonl.config_values(docs, "t", ["a", "b"]).collect()}
    assert got == {(1, "a"): "(absent)", (1, "b"): "2", (2, "a"): "1", (2, "b"): "(absent)"}


def test_streaming_routes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines(tmp_path / "in", [{"id": "a", "status": "success", "conversations": [{"role": "user", "content": "x"}]}, {"id": "b", "status": "error", "conversations": []}, "bad"])
    base = str(tmp_path)
    for _ in range(2):  # the second run finds nothing new
        route_by_status(stream_records(spark, f"{base}/in"), f"{base}/good", f"{base}/bad", f"{base}/c").awaitTermination()
    assert spark.read.parquet(f"{base}/good").count() == 1 and spark.read.parquet(f"{base}/bad").count() == 2


# ---------------------------------------------------------------- profile


@pytest.mark.parametrize("values, q, want", [([1, 2, 3, 4], 0.5, 3), ([1, 2, 3], 0.5, 2), ([5], 0.99, 5), ([1, 1, 2, 9], 0.9, 9)])
def test_nearest_rank(spark, values, q, want):
    df = spark.createDataFrame([(v,) for v in values + [None]], "x int")
    got = stats.nearest_rank(df, [], "x", {"p": q}).first()
    assert got["p"] == want and got["n"] == len(values)


def test_nearest_rank_of_nothing(spark):
    assert stats.nearest_rank(spark.createDataFrame([], "g string, x int"), ["g"], "x", {"p": 0.5}).count() == 0


def test_words_split_like_python(spark):
    for t in ["a b", "a b", "a　b", "a\x1cb", "a​b", "  a\tb\n", "", " ", "a\u0085b c", "é ü"]:
        assert one(spark, t, "string", tx.word_count) == len(t.split()), repr(t)


def test_roles_ids_and_empty_conversations(spark):
    rows = [(1, "a", [("user", "x"), ("tool", "y"), (None, None)]), (2, "a", []), (3, None, None), (4, "b", [("assistant", "z")])]
    df = spark.createDataFrame(rows, f"r long, id string, m {MSG}")
    c = profile.row_counters(df, [], "m").first()
    assert (c["n_rows"], c["n_bad"], c["empty_conv"], c["first_not_user"]) == (4, 1, 1, 1)
    assert {r["role"]: r["messages"] for r in profile.role_counts(df, "m").collect()} == {"user": 1, "tool": 1, "?": 1, "assistant": 1}
    i = profile.id_report(df, [], "id", "m").first()
    assert (i["ids"], i["distinct_ids"], i["dup_ids"]) == (3, 2, 1)
    t = {r["r"]: r for r in profile.turns(df, ["r"], "m").collect()}
    assert t[2]["turns"] == 0 and t[2]["user_turns"] is None and 3 not in t
    chars = profile.messages_of(df, ["r"], "m").where("role = '?'").first()["chars"]
    assert chars == 4  # a missing content counts as the text None


def test_message_helpers(spark):
    m = [("user", "a"), ("assistant", "b"), ("user", None)]
    assert one(spark, m, MSG, lambda x: first_content(x, "user")) == "a"
    assert one(spark, m, MSG, lambda x: last_content(x, "user")) is None
    assert one(spark, None, MSG, lambda x: last_content(x, "user")) is None
    assert one(spark, [], MSG, lambda x: first_content(x, "user")) is None


# ---------------------------------------------------------------- routes and splits


@pytest.mark.parametrize("n, k", [(1, 0), (2, 0), (5, 0), (15, 2), (25, 2), (35, 4)])
def test_eval_size_rounds_half_to_even(spark, n, k):
    assert one(spark, n, "int", lambda x: routing.eval_size(x, share=0.1)) == k
    assert one(spark, n, "int", lambda x: routing.eval_size(x, fixed=20)) == min(20, n)


@pytest.mark.parametrize("buckets", [1, 7, 4096])
def test_stratified_split_is_exact_for_any_buckets(spark, buckets):
    df = spark.createDataFrame([(i, "a" if i % 3 else None) for i in range(300)], "id long, s string")
    split = routing.stratified_split(df, "s", "id", 0, share=0.1, buckets=buckets)
    want = routing.stratified_split(df, "s", "id", 0, share=0.1)
    assert sorted(map(tuple, split.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert split.where("split = 'eval'").count() == 30 and split.count() == 300


def test_routes(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "a"), (5, "c"), (6, "")], "r long, id string")
    t, e = (spark.createDataFrame([(x,) for x in xs], "id string") for xs in (["a", "a", None, ""], ["a", "b"]))
    got = {r["r"]: r["split"] for r in routing.route_by_id(rows, t, e).collect()}
    assert got == {1: "train", 2: "eval", 3: None, 4: "train", 5: None, 6: None}
    assert {r["r"] for r in routing.dropped(rows, t, e).collect()} == {3, 5, 6}


def test_resume_tries_failed_rows_again(spark):
    todo = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "id string")
    done = spark.createDataFrame([("a", "success"), ("b", "error"), ("c", None)], "id string, status string")
    assert {r["id"] for r in routing.to_do(todo, done).collect()} == {"b", None}


def test_skeleton_and_regeneration(spark):
    u, a, s = ("user", "q"), ("assistant", "old"), ("system", "s")
    rows = [(1, [s, u, a, u]), (2, []), (3, None), (4, [a, u]), (5, [u, ("tool", "t")]), (6, [(None, "x"), u])]
    df = spark.createDataFrame(rows, f"r long, m {MSG}")

    def completer(messages):
        if sum(m["role"] == "user" for m in messages) == 2:
            assert messages[2]["content"] == "new 1"  # it sees its own earlier answer
        return f"new {sum(m['role'] == 'user' for m in messages)}"

    got = {r["r"]: r for r in complete.regenerate(df, "r", "m", completer).collect()}
    assert [m["content"] for m in got[1]["conversations"]] == ["s", "q", "new 1", "q", "new 2"] and got[1]["status"] == "success"
    assert {k: got[k]["error"] for k in (2, 3, 4, 5, 6)} == {2: "missing conversations", 3: "missing conversations", 4: "conversation starts with assistant", 5: "invalid role: tool", 6: "invalid role: ?"}

    def failing(messages):
        raise TimeoutError("timed out")

    assert {r["error"] for r in complete.regenerate(df.where("r = 1"), "r", "m", failing, endpoints=2).collect()} == {"timed out"}


def test_prompt_prefix(spark):
    u, a = ("user", "q"), ("assistant", "x")
    assert len(one(spark, [u, u, a, u], MSG, routing.prompt_prefix)) == 2
    assert len(one(spark, [u], MSG, routing.prompt_prefix)) == 1
    assert one(spark, [a], MSG, routing.prompt_prefix) == []


# ---------------------------------------------------------------- token samples


def test_render_and_spans(spark):
    m = [("user", "q"), ("assistant", "one"), ("user", "r"), ("assistant", tx.LOSS_PREFIX + "two")]
    text = one(spark, m, MSG, tx.render)
    assert text.count(tx.LOSS_PREFIX) == 2
    assert one(spark, text, "string", tx.assistant_spans) == ["one<turn|>\n", "two<turn|>\n"]
    assert one(spark, text[: -len("wo<turn|>\n")], "string", tx.assistant_spans) == ["one<turn|>\n", "t"]  # an open last turn runs to the end
    assert one(spark, [("assistant", None)], MSG, tx.render) is None
    assert one(spark, [("tool", "x")], MSG, tx.render) is None


def test_masks_and_anchors(spark):
    df = spark.createDataFrame([(1, [("user", "a b"), ("assistant", "c d e")])], f"r long, m {MSG}")
    s = anchors.tokenised(df, "r", "m").first()
    assert len(s["input_ids"]) == len(s["loss_mask"]) == len(s["attention_mask"]) and sum(s["loss_mask"]) == 3
    short = anchors.tokenised(df, "r", "m", max_length=3).first()
    assert len(short["input_ids"]) == 3
    for mask, want in [([0, 1, 1, 1, 0], [1, 2]), ([1], []), ([], []), ([0, 0], []), ([1, 1], [0])]:
        assert one(spark, mask, "array<int>", anchors.valid_anchors) == want
    m = spark.createDataFrame([(1, [1, 1, 1, 0]), (2, [0, 0])], "r long, m array<int>")
    got = {r["r"]: r for r in anchors.sampled_anchors(m, "r", "m", 3, 0).collect()}
    assert sorted(got[1]["anchors"][:2]) == [0, 1] and got[1]["keep_mask"] == [True, True, False] and got[2]["keep_mask"] == [False] * 3
    steps = {r["step"]: r["n"] for r in anchors.supervised_steps(m, "r", "m", 3).collect()}
    assert steps == {0: 2, 1: 1}


def test_step_weights():
    assert vx.step_weights(3, 4.0) == [1.0, math.exp(-0.25), math.exp(-0.5)] and vx.step_weights(3, 0) == [1.0] * 3


# ---------------------------------------------------------------- caches


def test_ordinals_and_ranks(spark):
    df = spark.createDataFrame([(x,) for x in "kjihgfedcba"], "k string")
    rows = cache.dense_ordinal(df, ["k"], "o")
    assert [r["o"] for r in rows.orderBy("k").collect()] == list(range(11))
    o, n = F.col("o"), F.lit(11)
    got = rows.select(cache.contiguous_rank(o, n, 4).alias("c"), cache.rotating_rank(o, n, 4, 1).alias("r"), cache.modulo_rank(o, 4).alias("m")).collect()
    assert sorted(r["c"] for r in got) == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3, 3]
    assert sum(r["r"] is None for r in got) == 3 and sorted(r["m"] for r in got).count(0) == 3


def test_greedy_shards_and_index(spark):
    sizes = [40, 50, 30, 90, 10]
    df = spark.createDataFrame([(0, i, n) for i, n in enumerate(sizes)] + [(1, 5, 150), (1, 6, 1)], "writer int, ordinal long, nbytes long")
    rolled = cache.roll_shards(df, 100)
    got = [(r["local_shard"], r["shard_offset"]) for r in rolled.orderBy("ordinal").collect()]
    assert got == [(0, 0), (0, 40), (1, 0), (2, 0), (2, 90), (0, 0), (1, 0)]
    index = cache.merged_index(rolled, df.select("ordinal", F.lit(3).alias("seq_len")), hidden=4, kv={"k": (1, 2)})
    rows = index.orderBy("sample_id").collect()
    assert [r["shard_id"] for r in rows] == [0, 0, 1, 2, 2, 3, 4] and [r["sample_id"] for r in rows] == list(range(7))
    assert (rows[1]["off_input_ids"], rows[1]["off_loss_mask"], rows[1]["off_last_hidden"], rows[1]["off_k"]) == (40, 52, 55, 79)
    m = cache.manifest(index).first()
    assert m["num_samples"] == 7 and m["num_shards"] == 5 and m["shards"][4]["file_name"] == "shard-00004.bin"


def test_checks_find_faults(spark):
    good = [(0, 0, 2, 0, 8, 10), (1, 0, 3, 20, 32, 35)]
    schema = "sample_id long, shard_id int, seq_len int, off_input_ids long, off_loss_mask long, off_last_hidden long"
    ok = lambda rows: {r["check_name"]: r["ok"] for r in cache.index_checks(spark.createDataFrame(rows, schema)).collect()}
    assert all(ok(good).values())
    bad = ok([good[0], (2, 2, 0, 20, 31, 35)])
    assert not (bad["dense_samples"] or bad["dense_shards"] or bad["positive_lengths"] or bad["offsets_follow_fields"])


def test_sample_bytes(spark):
    assert one(spark, 1, "int", cache.sample_bytes) == 17_925


def test_padding(spark):
    df = spark.createDataFrame([(1, 0, [1, 2, 3], [0, 1, 1]), (2, 0, [4, 5], [1, 1])], "r long, b int, ids array<int>, mask array<int>")
    got = {r["r"]: r for r in cache.padded_batches(df, "b", {"ids": 999, "mask": 0}).collect()}
    assert got[2]["ids"] == [4, 5, 999] and got[2]["mask"] == [1, 1, 0] and got[1]["ids"] == [1, 2, 3]


def test_buffered_shuffle_is_a_bounded_permutation(spark):
    df = spark.range(500)
    out = cache.buffered_shuffle(df, ["id"], 20, 0)
    rows = out.collect()
    assert sorted(r["id"] for r in rows) == list(range(500))
    for part in {r["part"] for r in rows}:
        mine = [r for r in rows if r["part"] == part]
        start = min(r["id"] for r in mine)
        assert all(r["out_rank"] >= (r["id"] - start) - 19 for r in mine)
    assert [r["id"] for r in sorted(rows, key=lambda r: (r["part"], r["out_rank"]))] != list(range(500))


def test_payload_round_trip(spark):
    rows = [(1, [1, 2], [0, 1], [[1.0, 2.5], [3.0, -4.0]], [[[1.0], [2.0]], [[3.0], [4.0]]]), (2, [], [], [], [[], []])]
    df = spark.createDataFrame(rows[:1], "r long, i array<int>, m array<int>, h array<array<double>>, k array<array<array<double>>>")
    back = payload.decode_samples(payload.encode_samples(df, "r", "i", "m", "h", "k"), "r", 2).first()
    assert (back["input_ids"], back["loss_mask"], back["last_hidden"], back["kv"]) == rows[0][1:]
    assert payload.from_bfloat16(payload.to_bfloat16([1 / 3]))[0] == pytest.approx(1 / 3, rel=1 / 128)


# ---------------------------------------------------------------- vectors and acceptance


def test_vectors(spark):
    v = lambda f, *xs: spark.createDataFrame([xs], ", ".join(f"x{i} array<double>" for i in range(len(xs)))).select(f(*[F.col(f"x{i}") for i in range(len(xs))]).alias("y")).first()["y"]
    assert v(vx.argmax, [1.0, 3.0, 3.0]) == 1
    assert v(vx.softmax, [0.0, 0.0]) == pytest.approx([0.5, 0.5])
    assert v(vx.softmax, [1000.0, 0.0]) == pytest.approx([1.0, 0.0])
    assert v(vx.l1, [0.0, 0.0], [0.0, 0.0]) == 0 and v(vx.cosine, [1.0, 0.0], [0.0, 1.0]) == 0
    assert v(vx.soft_cross_entropy, [0.0, 0.0], [0.0, 0.0]) == pytest.approx(math.log(2))
    assert v(vx.unit, [0.0, 0.0]) == [0.0, 0.0] and v(lambda x: vx.soft_cap(x, 0), [5.0]) == [5.0]
    assert one(spark, [[[1, 2], [3, 4], [5, 6]]], "array<array<array<int>>>", lambda x: vx.transpose(x[0])) == [[1, 3, 5], [2, 4, 6]]


@pytest.mark.parametrize("draft, target, n, kept", [([1, 2, 3], [1, 2, 3], 3, [9, 1, 2, 3]), ([7, 2, 3], [1, 2, 3], 0, [9, 1]), ([1, 2, 9], [1, 2, 3], 2, [9, 1, 2, 3])])
def test_acceptance(spark, draft, target, n, kept):
    row = spark.createDataFrame([(draft, target)], "d array<int>, t array<int>")
    got = row.select(accept.accepted(F.col("d"), F.col("t")).alias("n"), accept.committed(F.lit(9), F.col("d"), F.col("t")).alias("c"), accept.first_divergence(F.col("d"), F.col("t")).alias("x")).first()
    assert got["n"] == n and got["c"] == kept and got["x"] == (n if n < 3 else None)
    m = accept.acceptance(row, "d", "t").first()
    assert m["accepted"] == n and m["accept_len"] == 1 + n
    assert sum(r["accepted"] for r in accept.acceptance_by_place(row, "d", "t").collect()) == n


def test_rejection(spark):
    df = spark.createDataFrame([(0.5, 1.0, 0.5), (0.5, 1.0, 0.6), (0.5, 0.0, 0.1)], "p double, q double, u double")
    assert [r["a"] for r in df.select(accept.rejection_accept(F.col("p"), F.col("q"), F.col("u")).alias("a")).collect()] == [True, False, False]


def test_read_rates(spark):
    from loomspark.operators.readbench import read_list, timed

    index = spark.range(50).select(F.col("id").alias("sample_id"), F.lit(0).alias("shard_id"), F.lit(7).alias("seq_len"))
    assert [r["sample_id"] for r in read_list(index, 5, "seq").orderBy("place").collect()] == [0, 1, 2, 3, 4]
    assert len({r["sample_id"] for r in read_list(index, 5, "random").collect()}) == 5
    assert timed(index, "seq_len")["rows"] == 50 and timed(index.where("false"), "seq_len")["mb_per_second"] == 0


def test_file_names(spark):
    assert one(spark, "layer1_x_regen.jsonl", "string", tx.layer_of_file) == "layer1_x"
    assert one(spark, "out/a.jsonl", "string", tx.error_path) == "out/a_error.jsonl"
    assert one(spark, "x" * 201, "string", tx.preview) == "x" * 200 + "..." and one(spark, "x", "string", tx.preview) == "x"


def test_nearest(spark):
    from loomspark.operators.nearest import nearest_by_cosine

    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [2.0, 0.0]), (5, [0.0, 0.0])], "i long, v array<double>")
    got = {r["i"]: r["near"] for r in nearest_by_cosine(df, df, "i", "v", block=2).collect()}
    assert got[1] == 4 and got[4] == 1 and got[3] == 2


def test_stages_are_skipped_where_done(spark, tmp_path):
    stages = [Stage("a", f"{tmp_path}/a", lambda s, _: s.range(3)), Stage("b", f"{tmp_path}/b", lambda s, o: o["a"].where("id > 0"))]
    assert run_stages(spark, stages, only="a") == {"a": "ran", "b": "left out"}
    assert run_stages(spark, stages) == {"a": "there", "b": "ran"}
    assert spark.read.parquet(f"{tmp_path}/b").count() == 2


def test_files_named_by_value_appear_whole(spark, tmp_path):
    df = spark.createDataFrame([(i, "a b" if i % 3 else None) for i in range(30)], "n long, part string")
    assert sorted(jsonl.write_files(df, str(tmp_path / "one"), "part", "{}_regen.jsonl")) == ["a b_regen.jsonl", "unknown_regen.jsonl"]
    assert sorted(x.name for x in (tmp_path / "one").iterdir() if x.suffix == ".jsonl") == ["a b_regen.jsonl", "unknown_regen.jsonl"]
    names = jsonl.write_files(df, str(tmp_path / "many"), "part", "{}_regen.jsonl", parts=3)
    got = jsonl.read_lines(spark, str(tmp_path / "many"), "*_regen*.jsonl").groupBy("file_layer").count().collect()
    assert len(names) > 2 and {r["file_layer"]: r["count"] for r in got} == {"a b": 20, "unknown": 10}
    with pytest.raises(Exception):
        jsonl.write_files(df, str(tmp_path / "one"), "part", "{}_regen.jsonl")


def test_objects_are_replaced_whole(spark, tmp_path):
    for value in ({"a": 1}, {"a": "ü"}):
        jsonl.write_object(spark, str(tmp_path / "m.json"), value)
        assert json.loads((tmp_path / "m.json").read_text(encoding="utf-8")) == value
    assert [x.name for x in tmp_path.iterdir() if not x.name.startswith(".")] == ["m.json"]


def test_layers_are_run_one_by_one(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines(tmp_path / "in", [{"id": "a"}, {"id": "b"}], "l1.jsonl")
    (tmp_path / "in" / "l2.jsonl").write_text("")
    run = lambda rows, layer: jsonl.parse(rows).select("id", F.lit(layer).alias("of"))
    said = run_layers(spark, str(tmp_path / "in"), str(tmp_path / "out"), run, ["l1", "l2", "l3"], str(tmp_path / "final"))
    assert said == {"l1": "ran", "l2": "empty file", "l3": "no input file"}
    assert (tmp_path / "out" / "l1_regen.jsonl").read_text() == (tmp_path / "final" / "l1_regen.jsonl").read_text() != ""
    assert run_layers(spark, str(tmp_path / "in"), str(tmp_path / "all"), run) == {"l1": "ran", "l2": "empty file"}


def test_written_rows_are_counted(spark, tmp_path):
    assert write_counted(spark.range(10).repartition(3), str(tmp_path / "t")) == 10
    assert write_counted(spark.range(0), str(tmp_path / "none")) == 0


def _cache(spark):
    samples = spark.createDataFrame([(i, 40 + i) for i in range(6)], "ordinal long, seq_len int")
    rolled = cache.roll_shards(samples.select(F.lit(0).alias("writer"), "ordinal", F.col("seq_len").cast("long").alias("nbytes")), 100)
    return cache.merged_index(rolled, samples)


def test_index_records_have_72_bytes_and_come_back(spark):
    index = _cache(spark)
    records = cache.index_records(index)
    assert {len(r["record"]) for r in records.collect()} == {cache.INDEX_RECORD}
    columns = [c for c in index.columns if c != "ordinal"]
    assert sorted(map(tuple, cache.decoded_index(records).select(columns).collect())) == sorted(map(tuple, index.select(columns).collect()))
    with pytest.raises(Exception):
        cache.decoded_index(records.withColumn("record", F.substring("record", 1, 71))).collect()


def test_manifest_checks_find_each_fault(spark):
    index = _cache(spark)
    m, records = cache.manifest(index), cache.index_records(index)
    files = m.select(F.explode("shards.file_name").alias("file_name"))
    ok = {"version", "record_size", "index_exists", "index_bytes", "shards_in_a_row", "shard_files", "num_samples"}

    def failed(m_=m, r=records, f=files):
        return {x["check_name"] for x in cache.manifest_checks(m_, r, f).collect() if not x["ok"]}

    assert failed() == set() and {x["check_name"] for x in cache.manifest_checks(m, records, files).collect()} == ok
    assert failed(m.withColumn("version", F.lit(2))) == {"version"} and failed(m.withColumn("index_record_size", F.lit(64))) == {"record_size"}
    assert failed(r=records.where("false")) == {"index_exists", "index_bytes", "num_samples"}
    assert failed(r=records.withColumn("record", F.substring("record", 1, 71))) == {"index_bytes"}
    assert failed(m.withColumn("shards", F.reverse("shards"))) == {"shards_in_a_row"} and failed(f=files.where("file_name <> 'shard-00001.bin'")) == {"shard_files"}
    assert [tuple(r) for r in cache.missing_shards(m, files.where("file_name <> 'shard-00001.bin'")).collect()] == [(1, "shard-00001.bin")]


def test_lookups_and_limits(spark):
    index = _cache(spark)
    asked = spark.createDataFrame([(5,), (0,), (5,), (99,)], "sample_id long")
    assert sorted(r["seq_len"] for r in cache.looked_up(index, asked).collect()) == [40, 45, 45]
    assert cache.limited(index, "sample_id", 2).count() == 2 and cache.limited(index, "sample_id", 0).count() == 6


def test_anchor_positions(spark):
    mask = [0, 1, 1, 1, 1, 0, 1, 1, 1, 1]
    assert one(spark, mask, "array<int>", lambda m: anchors.valid_anchors(m)) == [1, 2, 3, 6, 7, 8]
    assert one(spark, mask, "array<int>", lambda m: anchors.anchors_for(m, 2, 2)) == [3, 6] and one(spark, [], "array<int>", lambda m: anchors.anchors_for(m, 2, 2)) == []


def test_supervised_steps_without_anchors(spark):
    df = spark.createDataFrame([(1, [0, 1, 1, 1]), (2, [0, 0]), (3, [])], "i long, m array<int>")
    assert {(r["step"], r["n"]) for r in anchors.supervised_steps(df, "i", "m", 4).collect()} == {(0, 2), (1, 1)}
    assert anchors.supervised_steps(df.where("false"), "i", "m", 4).count() == 0


@pytest.mark.parametrize("query_block, block", [(4096, 65_536), (3, 5)])
def test_nearest_in_blocks(spark, query_block, block):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 4)).round(1)
    x[7] = x[9]  # ties go to the smaller id
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<double>")
    got = {r["i"]: r["near"] for r in nearest_by_cosine(df.where("i % 4 = 0"), df, "i", "v", query_block, block).collect()}
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-6)
    c = u @ u.T
    np.fill_diagonal(c, -np.inf)
    assert set(got) == set(range(0, 60, 4)) and all(np.isclose(c[i, j], c[i].max()) for i, j in got.items())
