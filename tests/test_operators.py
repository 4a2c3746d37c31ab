"""Gates, scorecard, selection, consensus, plan, validation, sessions against golden cases."""
import pytest
from pyspark.sql import functions as F

from winnowry.config import CompactionLimits
from winnowry.operators import aggregates, consensus, gates, joins, scorecard, selection, validation, windows
from winnowry.schemas import ALIGN, ASR, FILTER, PLAN, SPEAKER, schema
from winnowry.sources import readers, sinks
from winnowry.streaming import session


def rows(spark, ddl, *records):
    names = [f.name for f in schema(ddl)]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in records], schema(ddl))


BASE = {
    "f": dict(path="BV1_a.wav", duration=4.0, rms_db=-20.0, voiced_ratio=0.3, f0_cv=0.3, longest_voiced=0.5), "s": dict(path="BV1_a.wav", decision="accept", score=0.55, score_lower=0.4),
    "a": dict(path="BV1_a.wav", lang="zh", text="大家好今天也来直播啦", language_probability=0.95, avg_logprob=-0.3, max_no_speech_probability=0.1, max_compression_ratio=1.2), "g": dict(path="BV1_a.wav", similarity=0.95, keep=True),
}


def card(spark, tier="B", drop=(), **changes):
    parts = {k: {**v, **changes.get(k, {})} for k, v in BASE.items()}
    tables = [rows(spark, ddl, *([] if k in drop else [parts[k]])) for k, ddl in (("f", FILTER), ("s", SPEAKER), ("a", ASR), ("g", ALIGN))]
    plan = rows(spark, PLAN, dict(source_id="BV1", tier=tier, risk=[]))
    return scorecard.scorecard(scorecard.union_of_stages(*tables, plan)).first()


def test_scorecard(spark):
    assert card(spark)["decision"] == "candidate"
    assert card(spark, f={"duration": 25.0})["reject_reasons"] == ["duration"]
    assert card(spark, "A", g={"similarity": 0.47})["reject_reasons"] == ["alignment"]
    assert card(spark, "C", g={"similarity": 0.47})["reject_reasons"] == []
    assert card(spark, "A", s={"score_lower": 0.1})["reject_reasons"] == ["speaker"]
    assert {"missing_asr", "missing_alignment"} <= set(card(spark, drop=("a", "g"))["reject_reasons"])
    assert card(spark, g={"similarity": 0.9})["score"] < card(spark)["score"]


def items(spark, spec):
    out = []
    for lang, n, score, source in spec:
        out += [(f"/{lang}{source}{k:04d}", lang, source or f"s{k}", "candidate", float(score), f"text {lang} {source} {k}") for k in range(n)]
    return spark.createDataFrame(out, "path string, lang string, source_id string, decision string, score double, text string")


def counts(selected):
    return {r["lang"]: r["n"] for r in selected.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}


def test_selection(spark):
    assert counts(selection.select_quota(items(spark, [("zh", 100, 80, ""), ("ja", 500, 80, "")]), 200, 0.6, 70, 1.0)) == {"zh": 100, "ja": 66}
    assert counts(selection.select_quota(items(spark, [("zh", 200, 80, ""), ("ja", 200, 80, "")]), 200, 0.6, 70, 1.0)) == {"zh": 120, "ja": 80}
    capped = selection.select_quota(items(spark, [("zh", 100, 90, "one"), ("ja", 100, 80, "")]), 100, 0.6, 70, 0.15)
    assert capped.where("source_id = 'one'").count() <= 9
    same = spark.createDataFrame([("/b", "zh", "x", "candidate", 70.0, "同一句话"), ("/a", "zh", "x", "candidate", 90.0, "同一句话！"), ("/c", "zh", "x", "borderline", 99.0, "别的")], "path string, lang string, source_id string, decision string, score double, text string")
    assert [r["path"] for r in selection.select_quota(same, 10, 0.6, 60, 1.0).collect()] == ["/a"]
    stats = selection.selection_stats(items(spark, [("zh", 100, 80, ""), ("ja", 500, 80, "")]), selection.select_quota(items(spark, [("zh", 100, 80, ""), ("ja", 500, 80, "")]), 200, 0.6, 70, 1.0), 200, 0.6, 70, 1.0).first()
    assert (stats["shortfall"], stats["n_total"], stats["n_primary"]) == (True, 166, 100)


def test_consensus(spark):
    pairs = [("你好，世界！", "你好世界", None), ("今天天气很好", "完全不同的话", None), ("", "", None), ("只有一个", "", None)]
    table = spark.createDataFrame([(k, *p, None, None) for k, p in enumerate(pairs)], "k int, primary string, secondary string, third string, primary_logprob double, secondary_logprob double")
    assert [(r["decision"], r["tier"]) for r in consensus.adjudicate(table).orderBy("k").collect()] == [("keep", "strict"), ("drop", "drop_low_sim"), ("drop", "drop_empty"), ("drop", "drop_no_pair")]


def test_cascade(spark):
    base = dict(path="p", lang="zh", text="正常|文本真的很好", whitelisted=True, filter_keep=True, decision="accept", align_keep=True, align_reason=None, similarity=0.9, forced_text=None, aligned=True, asr_quality_version=1, audio_duration=3.0, language_probability=0.9, avg_logprob=-0.2, max_no_speech_probability=0.1, max_compression_ratio=1.2, file_size=9000)
    changes = [({}, None), ({"filter_keep": False}, "audio_filter"), ({"decision": "reject"}, "speaker_reject"), ({"lang": "ko"}, "language"), ({"text": "啊啊啊啊啊啊啊"}, "text_repetitive_char"), ({"aligned": False}, "alignment_missing"), ({"avg_logprob": None}, "asr_logprob"), ({"language_probability": None}, None), ({"file_size": 10}, "tiny_audio"), ({"file_size": None}, "missing_audio"), ({"similarity": 0.3}, "alignment_low_sim")]
    ddl = "k int, path string, lang string, text string, whitelisted boolean, filter_keep boolean, decision string, align_keep boolean, align_reason string, similarity double, forced_text string, aligned boolean, asr_quality_version int, audio_duration double, language_probability double, avg_logprob double, max_no_speech_probability double, max_compression_ratio double, file_size long"
    table = spark.createDataFrame([(k, *{**base, **c}.values()) for k, (c, _) in enumerate(changes)], ddl)
    got = gates.cascade(table).orderBy("k").collect()
    assert [r["reason"] for r in got] == [x for _, x in changes]
    assert got[0]["final_text"] == "正常/文本真的很好"


def test_select_slices_wants_complete_tables(spark):
    slices = spark.createDataFrame([("a",), ("b",)], "path string")
    filters = rows(spark, FILTER, dict(path="a", keep=True), dict(path="b", keep=False))
    speakers = rows(spark, SPEAKER, dict(path="a", decision="uncertain"))
    assert gates.select_slices(slices, filters, speakers, "accept-or-uncertain").count() == 1
    assert gates.select_slices(slices, filters, speakers, "accept").count() == 0
    with pytest.raises(Exception, match="no filter row"):
        gates.select_slices(slices, filters.where("path = 'a'"), speakers, "accept").collect()


def test_validation_and_listening(spark):
    table = items(spark, [("zh", 60, 80, ""), ("ja", 40, 80, "")]).withColumns({"tier": F.lit("B"), "text": F.concat(F.lit("大家好今天也来直播啦"), F.conv(F.substring("path", -4, 4), 10, 36))})
    scores = table.select("path", "decision", "score", F.struct(F.lit(0.6).alias("similarity"), F.lit(0.5).alias("score_lower")).alias("metrics"))
    stats = spark.createDataFrame([(100, False, 60)], "n_total long, shortfall boolean, n_primary long")
    lines = table.select(F.concat(F.col("path"), F.lit("|h|ZH|x")).alias("value"))
    checks = {r["id"]: r["pass"] for r in validation.validate(table, stats, scores, lines, table.select("path"), 0.6, 0.15).collect()}
    assert checks["V1"] and checks["V2"] and checks["V3"] and checks["V4"] and checks["V5"] and checks["V6"] and checks["V8"]
    sample = validation.listen_sample(table, scores, 20, 7)
    assert sample.count() == sample.select("path").distinct().count() <= 20
    told = spark.createDataFrame([("L1", "OK")] * 19 + [("L1", "非本人")], "layer string, label string")
    got = validation.evaluate_listening(told).first()
    assert got["pass"] and got["ok_rate"] == 0.95


def test_compaction(spark):
    talk = spark.createDataFrame([("s", k, "user" if k % 2 == 0 else "assistant", "x") for k in range(25)] + [("t", 0, "user", "x")], "session_id string, turn long, role string, content string")
    assert [tuple(r) for r in session.plan_compaction(talk).collect()] == [("s", 8)]
    assert session.plan_compaction(talk, CompactionLimits(trigger_turns=20)).count() == 0
    assert session.committed(talk).count() == 24
    marked = session.archived_messages(talk, session.plan_compaction(talk))
    digest = session.prefix_digest(marked)
    current = digest.withColumn("summary", F.lit(""))
    planned = digest.withColumn("previous_summary", F.lit(""))
    summary = spark.createDataFrame([("s", " all  good ")], "session_id string, summary string")
    assert session.apply_compaction(marked, current, planned, summary).where("session_id = 's'").count() == 17
    stale = planned.withColumn("previous_summary", F.lit("other"))
    assert session.apply_compaction(marked, current, stale, summary).where("session_id = 's'").count() == 25


def test_sources_and_sinks(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text('[{"path": "x", "keep": true}, {"path": "y"}]')
    assert readers.read_json_list(spark, str(path), FILTER).count() == 2
    assert readers.read_json_list(spark, str(tmp_path / "none.json"), FILTER, required=False).count() == 0
    with pytest.raises(FileNotFoundError):
        readers.read_json_list(spark, str(tmp_path / "none.json"), FILTER)
    path.write_text('{"version": 1, "items": [{"path": "x"}]}')
    assert readers.read_items(spark, str(path), FILTER).count() == 1
    (tmp_path / "list.txt").write_text("# c\n a.wav \n\nb.wav\na.wav\n")
    names = readers.training_assets(readers.read_lines(spark, str(tmp_path / "list.txt")))
    assert sorted(r["name"] for r in names.collect()) == ["a.wav", "b.wav"]
    sinks.write_table(names, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    with pytest.raises(Exception, match="NaN"):
        sinks.write_table(spark.sql("select double('nan') as x"), str(tmp_path / "bad"))
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert sorted(map(tuple, sinks.upsert(old, spark.createDataFrame([("b", 9), ("c", 3)], "k string, v int"), "k").collect())) == [("a", 1), ("b", 9), ("c", 3)]


def test_windows_and_joins(spark):
    frames = spark.createDataFrame([("k", i, f) for i, f in enumerate([True, True, False, True, True, True])], "key string, i int, flag boolean")
    assert tuple(windows.islands(frames, "key", "i", "flag").first()) == ("k", 3, 3)
    a, b = spark.createDataFrame([("x",), ("y",)], "k string"), spark.createDataFrame([("y",), ("z",)], "k string")
    assert {r["part"]: r["keys"] for r in joins.key_counts({"a": a, "b": b}, "k").collect()} == {"a": 2, "b": 2, "all": 1}
    assert {r["reason"]: r["n"] for r in aggregates.reason_counts(spark.sql("select array('a', 'b') as reasons union all select array()")).collect()} == {"keep": 1, "drop": 1, "a": 1, "b": 1}
    assert selection.balanced_shards([("a", 5), ("b", 3), ("c", 3)], 2) == [["a"], ["b", "c"]]


def test_order_statistics(spark):
    values = [5.0, 1.0, 1.0, 9.0, 3.0, None, 7.0, 2.0]
    table = spark.createDataFrame([(v,) for v in values], "x double")
    got = aggregates.order_statistics(table, "x", {"mid": (1, 2), "low": (1, 10), "high": (9, 10)}).first()
    known = sorted(v for v in values if v is not None)
    assert tuple(got) == (known[len(known) // 2], known[len(known) // 10], known[len(known) * 9 // 10])
    assert tuple(aggregates.order_statistics(table.limit(0), "x", {"mid": (1, 2)}).first()) == (None,)


def test_retrieval(spark):
    from winnowry.operators import retrieval

    facts = spark.createDataFrame([("f1", "profile", ["生日", "蛋糕"], "五月", 1), ("f2", "sensitive", ["男朋友"], "x", 2)], "id string, cat string, q array<string>, fact string, ordinal long")
    asked = spark.createDataFrame([(1, "你的生日吃蛋糕吗"), (2, "男朋友生日"), (3, "天气")], "query_id long, text string")
    found = retrieval.retrieve_facts(asked, facts)
    assert sorted((r["query_id"], r["sensitive"], r["fact_id"]) for r in found.collect()) == [(1, False, "f1"), (2, True, None)]
    shown = spark.createDataFrame([(1, "你好", 1)], "query_id long, text string, rank int")
    messages = {r["query_id"]: [m["content"] for m in r["messages"]] for r in retrieval.compose_context(asked, found, shown, "avoid").collect()}
    assert messages[2] == ["avoid"] and len(messages[1]) == 2 and messages[3] == []
