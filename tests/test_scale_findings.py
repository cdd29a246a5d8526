"""Small tests of what the review of larger tables found: shared steps, parts that grow with the input, exact results."""

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tokenmill.functions import fixed, text
from tokenmill.operators import compression, intent
from tokenmill.streaming import stateful

LONG = " ".join(f"word{i % 37} the is of rare{i}." for i in range(40))
PROMPTS = [
    (1, LONG), (2, "short"), (3, ""), (4, None), (5, LONG + "\nConnection lost.\nConnection lost.\nConnection lost.\nResolved 3 packages\n"),
    (6, "Hello! Please, could you help me " + LONG), (7, " \n "), (8, "A\r\nB\r\n" + LONG), (9, LONG.upper() + "\n\n\n? ! : - ."),
]


def test_report_does_shared_steps_once(spark, monkeypatch):
    prompts = spark.createDataFrame(PROMPTS, "doc_id long, text string")
    columns = ["method", "reason", "bypassed", "original_tokens", "compressed_tokens", "ratio"]
    methods = [("disabled", True), ("rtk", True), ("caveman", True), ("stacked", True), ("llmlingua", True), ("rtk+llmlingua", True), ("llmlingua", False)]
    want = Counter(tuple(r) for m, loaded in methods for r in compression.compress(prompts, m, model_loaded=loaded).select(columns).collect())
    calls, whole = [], compression.compress_log_text
    monkeypatch.setattr(compression, "compress_log_text", lambda *a: calls.append(a) or whole(*a))
    got = Counter(tuple(r) for r in compression.method_figures(prompts).select(columns).collect())
    assert got == want and len(calls) == 1


def test_pleasantries_are_looked_for_where_their_words_are(spark):
    odd = ["Hello hi", "thank please you so", "pleaſe go", "thanK you", "Hİ there", "kındly do", "could\nyou", "CAN YOU help me to go!?", "shell", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "id int, t string")
    plain = F.col("t")
    for p in fixed.PLEASANTRIES:
        plain = F.regexp_replace(plain, text.whole_words([p]) + "[!,.:;?]*", "")
    for r in df.select("t", text._polite(F.col("t")).alias("got"), plain.alias("want")).collect():
        assert r.got == r.want, r


def test_word_functions_need_no_package_in_the_workers():
    for f in (compression._counted, compression._others, compression._kept):
        inner = [c for c in f.__code__.co_consts if hasattr(c, "co_names")]
        assert "fixed" not in {n for c in (f.__code__, *inner) for n in c.co_names}


def test_rows_of_a_key_are_plain_columns_in_order():
    parts = [pd.DataFrame({"t": [5, 3], "id": [1, 9], "x": ["a", "b"]}), pd.DataFrame({"t": [3, 4], "id": [2, 7], "x": ["c", None]})]
    rows = stateful._in_order(iter(parts), ["t", "id", "x"])
    assert {c: v.tolist() for c, v in rows.items()} == {"t": [3, 3, 4, 5], "id": [2, 9, 7, 1], "x": ["c", "b", None, "a"]}
    assert all(isinstance(v, np.ndarray) for v in rows.values())


def test_grams_meet_in_parts_that_follow_the_size_of_the_samples(spark, monkeypatch):
    samples = spark.createDataFrame([("code" if i % 3 else "general", f"sort the list {i} sort the") for i in range(50)] + [("code", None), ("code", " ")],
                                    "intent string, sample_text string")
    want = sorted(map(tuple, intent.train_intent(samples).table().collect()))
    parts, write = [], intent.stage
    monkeypatch.setattr(intent, "stage", lambda df, name: parts.append(df.rdd.getNumPartitions()) or write(df, name))
    monkeypatch.setattr(intent, "PART_BYTES", 50)
    monkeypatch.setattr(intent, "SLICE", 7)
    assert sorted(map(tuple, intent.train_intent(samples).table().collect())) == want
    assert parts == [-(-sum(len(r.sample_text or "") for r in samples.collect()) // 50)]
    assert ("general", "sort the", 34) in {r[:3] for r in want}


def test_telegraphic_steps_are_plain_searches_with_the_same_results(spark):
    some = ["Hello the  a     of    x .", "İt ıS at\xa0the   you", " \t\r\n a\r\n\r\nb \x0b  the ! ?", "thanK you ,,; help me to HELP ME go", "a" + " " * 40 + "b  .", "Tähe _the the_ a1", "", " \n ", None]
    words = fixed.ARTICLES + fixed.AUXILIARIES + fixed.PREPOSITIONS_PRONOUNS
    c = F.regexp_replace("t", f"(?iu)(?<![{text.WORD}])(?:{'|'.join(fixed.PLEASANTRIES)})(?![{text.WORD}])[!,.:;?]*", "")
    c = text.strip(F.regexp_replace(text.strip(F.regexp_replace(c, " +", " ")), "^[!,.;? ]+", ""))
    c = F.regexp_replace(c, f"(?iu)(?<![{text.WORD}])(?:{'|'.join(words)})(?![{text.WORD}])", "")
    c = F.regexp_replace(F.regexp_replace(c, " +", " "), " +([?.!,;])", "$1")
    c = text.strip(F.regexp_replace(c, f"[{text.WS}]*[{text.LINE_END}][{text.WS}]*", "\n"))
    out = spark.createDataFrame([(t,) for t in some], "t string").select("t", text.telegraphic(F.col("t"), "ultra").alias("got"), c.alias("want"))
    for r in out.collect():
        assert r.got == r.want, r
    plan = out.select("got")._jdf.queryExecution().optimizedPlan().toString()
    # what is left to patterns: pleasantries, small words, long runs of blanks (twice)
    assert plan.count("regexp_replace(") == 4 and "translate(" not in plan


def test_prompts_are_prepared_in_one_pass_without_a_model(spark):
    from tokenmill.plans import gateway

    prompts = spark.createDataFrame([(1, "Ohne Cache: sort the list"), (2, "a function of"), (3, "functional"), (4, "(/nocache)"), (5, None), (6, "xkein cache y")], "doc_id long, text string")
    words = spark.createDataFrame([("list",)], "keyword string")
    ready = gateway.prepare_prompts(prompts, words, None)
    got = {r.doc_id: (r.blocked, r.bypass, r.intent) for r in ready.collect()}
    assert got == {1: (True, True, "general"), 2: (False, False, "code"), 3: (False, False, "general"),
                   4: (False, True, "general"), 5: (False, None, "general"), 6: (False, False, "general")}
    plan = ready._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    model = intent.train_intent(spark.createDataFrame([("general", "sort the list")], "intent string, sample_text string"))
    trained = gateway.prepare_prompts(prompts, words, model)
    assert trained.columns == ready.columns and sorted(map(tuple, trained.collect()), key=repr) == sorted(map(tuple, ready.collect()), key=repr)
    clean = {r[0] for r in prompts.select(text.strip_bypass(F.col("text"))).collect()}
    assert clean == {"sort the list", "a function of", "functional", "(/nocache)", None, "xkein cache y"}


def test_large_models_join_only_rare_grams(spark, monkeypatch):
    samples = spark.createDataFrame([(["a", "b", "c"][i % 3], f"sort the list w{i} sort  the\tlist v{i % 7}") for i in range(60)], "intent string, sample_text string")
    prompts = spark.createDataFrame([(i, f"sort w{i} the\nlist v{i % 7} v{i % 7} new{i}") for i in range(70)] + [(100, None), (101, ""), (102, "a function w1"), (103, " unknown ")],
                                    "doc_id long, text string")
    want = sorted(map(tuple, intent.classify_intent(prompts, intent.train_intent(samples)).collect()), key=repr)
    monkeypatch.setattr(intent, "SMALL_MODEL", 5)
    monkeypatch.setattr(intent, "SLICE", 8)
    joined, summed = [], intent._summed
    monkeypatch.setattr(intent, "_summed", lambda hot: joined.append(len(hot.value[0])) or summed(hot))
    for weights in (0, 30, 1_000_000):
        monkeypatch.setattr(intent, "HOT_WEIGHTS", weights)
        assert sorted(map(tuple, intent.classify_intent(prompts, intent.train_intent(samples)).collect()), key=repr) == want
    assert joined[0] <= 1 < joined[1] <= 10 < joined[2]
