import json

import pytest
from pyspark.sql import functions as F

from tokenmill.operators import conversations, intent, ordered
from tokenmill.sources import sinks, tables


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_price_feed(spark, tmp_path):
    doc = {"data": [{"id": "a/x", "pricing": {"prompt": "0.000001", "completion": "0.000002"}}, {"id": "", "pricing": {}},
                    {"pricing": {"prompt": "1"}}, {"id": "b/none"}, {"id": "c/free", "pricing": {"prompt": "oops"}}]}
    (tmp_path / "feed.json").write_text(json.dumps(doc, indent=1))
    got = [(r.model_name, float(r.input_price), float(r.output_price)) for r in tables.read_price_feed(spark, str(tmp_path / "feed.json")).collect()]
    assert got == [("a/x", 1e-6, 2e-6), ("c/free", 0.0, 0.0)]


def test_labelled_text_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("code", "a b\nc "), ("general", "x")], "intent string, sample_text string")
    tables.write_labelled_text(df, str(tmp_path / "t"))
    assert sorted(tuple(r) for r in tables.read_labelled_text(spark, str(tmp_path / "t")).collect()) == [("code", "a b c"), ("general", "x")]
    assert tables.parse_labelled(lines(spark, "", "  ")).count() == 0


def test_keys(spark):
    raw = spark.createDataFrame([(1, "active", "[1, 2]"), (2, "inactive", "oops"), (3, "active", None), (4, "active", "[]")],
                                "id long, status string, allowed_rules string").selectExpr("*", "'1.5' AS total_budget", "'2' AS remaining_budget", "'s' AS plain_key")
    out = tables.parse_api_keys(raw)
    assert [(r.active, r.allowed_rules) for r in out.orderBy("id").collect()] == [(True, [1, 2]), (False, None), (True, None), (True, [])]
    assert "plain_key" not in out.columns


def test_chat_requests(spark):
    body = {"model": "m", "messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "image", "text": "no"}, "b"]}]}
    row = tables.parse_chat_requests(lines(spark, json.dumps(body))).first()
    assert (row.temperature, row.stream, row.max_tokens) == (1.0, False, None)
    flat = tables.parse_chat_requests(lines(spark, json.dumps(body))).select(tables.flatten_content(F.col("messages")[0]["content"]).alias("t"))
    assert flat.first().t == "a b"


@pytest.mark.parametrize("content,want", [
    ("plain", "plain"), ("[not json", "[not json"), ('{"a": 1} fix this', '{"a": 1} fix this'), ("[1,2]", "[1,2]"), ('{"a":1}', '{"a":1}'),
    (["a", "b"], "a b"), ([{"type": "text"}, 1, "x"], " x"), ([], ""), ({"type": "text", "text": "a"}, ""), (7, ""), (None, ""), ("", ""),
])
def test_content(spark, content, want):
    body = json.dumps({"model": "m", "messages": [{"role": "user", "content": content}]})
    flat = tables.parse_chat_requests(lines(spark, body)).select(tables.flatten_content(F.col("messages")[0]["content"]).alias("t"))
    assert flat.first().t == want


def test_answers(spark):
    good = json.dumps({"choices": [{"message": {"role": "assistant", "content": "hi"}}]})
    rows = lines(spark, good, "just text").select(tables.parse_answer(F.col("value")).alias("a")).collect()
    assert [r.a.choices[0].message.content for r in rows] == ["hi", "just text"]


def test_rules_document(spark, tmp_path):
    rules = spark.createDataFrame([(2, "code", "b"), (1, "code", "a"), (3, "general", "c")], "id long, intent string, model string")
    sinks.export_rules_document(rules, str(tmp_path / "r"))
    doc = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "r")).collect()]
    assert sorted((r["intent"], r["place"], r["rule"]["id"]) for r in doc) == [("code", 1, 1), ("code", 2, 2), ("general", 1, 3)]


def test_price_snapshot_is_kept_when_empty(spark, tmp_path):
    path = str(tmp_path / "p")
    prices = spark.createDataFrame([("m", "p", 1.0, 2.0)], "model_name string, provider string, input_price double, output_price double")
    assert sinks.overwrite_price_snapshot(prices, path) and not sinks.overwrite_price_snapshot(prices.where("false"), path)
    assert sinks.read_price_snapshot(spark, path).count() == 1
    assert sinks.overwrite_price_snapshot(prices.withColumn("model_name", F.lit("n")), path)
    assert [r.model_name for r in sinks.read_price_snapshot(spark, path).collect()] == ["n"]


def test_token_log_files(spark, tmp_path):
    rows = spark.createDataFrame([(i, str(i % 3), f"2024-01-0{1 + i % 2} 00:00:00") for i in range(20)], "id long, api_key_id string, at string")
    sinks.write_token_logs(rows.withColumn("created_at", F.to_timestamp("at")), str(tmp_path / "l"))
    back = spark.read.parquet(str(tmp_path / "l"))
    assert back.count() == 20 and back.where("log_date = '2024-01-02'").count() == 10


def merged(spark, *turns):
    df = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    return [(r.role, r.content) for r in conversations.merge_roles(df).orderBy("place").collect()]


@pytest.mark.parametrize("hot", [1, 10**6])
def test_merge_roles(spark, monkeypatch, hot):
    monkeypatch.setattr(ordered, "HOT_ROWS", hot)
    monkeypatch.setattr(conversations, "TURN_SLICE", 2)
    assert merged(spark, ("system", "be kind"), ("user", "Hello"), ("user", "how are you?"), ("assistant", "fine"), ("tool", "42"),
                  ("user", "ok"), ("system", "brief")) == [
        ("system", "be kind\nbrief"), ("user", "Hello\n\nhow are you?"), ("assistant", "fine"), ("user", "[tool]: 42\n\nok")]


def provider(*events):
    return ["data: " + json.dumps(e) for e in events]


def test_event_fold(spark):
    rows = provider(
        {"type": "message_start", "message": {"usage": {"input_tokens": 45}}},
        {"type": "content_block_delta", "delta": {"text": " Hello"}}, {"type": "content_block_delta", "delta": {"text": " world"}},
        {"type": "message_delta", "delta": {"stop_reason": "end_turn"}, "usage": {"output_tokens": 85}}, {"type": "message_stop"},
    ) + ["event: x", "data: [DONE]", "data: {oops"]
    df = spark.createDataFrame([(7, i, v) for i, v in enumerate(rows)], "msg_id long, seq int, value string")
    out = conversations.fold_provider_events(tables.parse_sse_lines(df)).first()
    assert tuple(out) == (7, 45, 85, " Hello world", "stop", True)


def test_event_fold_estimates(spark):
    df = spark.createDataFrame([(7, 1, 'data: {"type":"content_block_delta","delta":{"text":"a b c"}}')], "msg_id long, seq int, value string")
    prompts = spark.createDataFrame([(7, "one two")], "msg_id long, text string")
    assert tuple(conversations.fold_provider_events(tables.parse_sse_lines(df), prompts).first()) == (7, 3, 4, "a b c", "stop", False)


SAMPLES = [
    ("code", "write a unit test for this parser"), ("code", "why does my loop never end in rust"), ("code", "sort a linked list in place"),
    ("creative", "a short poem about autumn rain"), ("creative", "write the opening of a ghost story"), ("support", "I was charged twice this month"),
    ("support", "the parcel has not arrived yet"), ("general", "how tall is the highest mountain"), ("general", None), (None, "no label"),
]


def test_intents(spark):
    model = intent.train_intent(spark.createDataFrame(SAMPLES, "intent string, sample_text string"))
    assert model.intents == ["code", "creative", "general", "support"]
    df = spark.createDataFrame([(1, "the loop in my parser"), (2, "a poem of rain"), (3, "my parcel was charged"), (4, "Tell me about HTML and a parcel"), (5, ""), (6, None)],
                               "doc_id long, text string")
    got = {r.doc_id: r.intent for r in intent.classify_intent(df, model).collect()}
    assert got == {1: "code", 2: "creative", 3: "support", 4: "code", 5: "code", 6: "code"}  # code has most samples
    assert {r.doc_id: r.intent for r in intent.classify_intent(df, None).collect()} == {i: "code" if i == 4 else "general" for i in range(1, 7)}


def test_intent_scores_match_a_plain_version(spark):
    import math
    from collections import Counter

    rows = [(i, t) for i, t in SAMPLES if i]
    grams = lambda t: (lambda w: w + [a + " " + b for a, b in zip(w, w[1:])])((t or "").lower().split())
    counts = {i: Counter(g for j, t in rows if j == i for g in grams(t)) for i, _ in rows}
    known = set().union(*counts.values())
    table = {(r.intent, r.gram): (r.n, r.weight) for r in intent.train_intent(spark.createDataFrame(SAMPLES, "intent string, sample_text string")).table().collect()}
    assert set(table) == {(i, g) for i, c in counts.items() for g in c}
    for (i, g), (n, w) in table.items():
        assert n == counts[i][g] and w == round(math.log((n + 0.1) / (sum(counts[i].values()) + 0.1 * len(known))) * 1e6)


def test_training_sources(spark):
    empty = spark.createDataFrame([], "intent string, sample_text string")
    own = spark.createDataFrame([("code", "x"), ("general", "y")], "intent string, sample_text string")
    assert intent.training_samples(None, empty) is None and intent.training_samples(empty, own).count() == 2
    assert intent.retrain(None, own).intents == ["code", "general"] and intent.retrain(None, empty) is None
    assert intent.train_intent(empty) is None


def test_embeddings(spark):
    df = spark.createDataFrame([("a b c",), ("d e",)], "text string")
    assert [len(r.embedding) for r in intent.embed(df, intent.fit_embedder(df, dimension=16)).collect()] == [16, 16]
    assert [list(r.embedding) for r in intent.embed(df, encode=lambda ts: [[3.0, 4.0] for _ in ts]).collect()] == [[pytest.approx(0.6), pytest.approx(0.8)]] * 2
