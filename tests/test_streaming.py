"""The sentence splitter, the style parser, and equality of batch and stream."""
import pytest

from winnowry.streaming import sentences


def cut(text, **options):
    return sentences.sentences_of(list(text), **options)


def test_splits():
    assert cut("你好世界。再见世界！") == ("日常", ["你好世界。", "再见世界！"])
    assert cut("好。真的很好。")[1] == ["好。真的很好。"]
    assert cut("我说（这里。不切）完了。")[1] == ["我说（这里。不切）完了。"]
    assert "".join(cut("字" * 200)[1]) == "字" * 200
    assert max(map(len, cut("字" * 200)[1])) <= 75
    assert cut("")[1] == []


@pytest.mark.parametrize("text, style, first", [("【说话语气：元气】大家好呀。", "元气", "大家好呀。"), ("说话语气：温柔\n晚安大家。", "温柔", "晚安大家。"), ("说什么呢大家。", "日常", "说什么呢大家。"), ("【说话语气：未知】啊啊啊啊。", "日常", "【说话语气：未知】啊啊啊啊。")])
def test_styles(text, style, first):
    got, pieces = cut(text)
    assert (got, [p.strip() for p in pieces]) == (style, [first])


def test_stream_equals_batch(spark, tmp_path):
    turns = {("s1", 0): "【说话语气：俏皮】你好世界。今天（笑）很好！", ("s2", 3): "没有标签的话，很长很长。结束"}
    rows = [(s, t, k, c) for (s, t), text in turns.items() for k, c in enumerate([*text, "\0"])]
    source = str(tmp_path / "tokens")
    half = len(rows) // 2
    for part in (rows[:half], rows[half:]):
        spark.createDataFrame(part, "session_id string, turn long, seq long, token string").coalesce(1).write.mode("append").parquet(source)
    batch = sentences.split_turns(spark.createDataFrame([r for r in rows if r[3] != "\0"], "session_id string, turn long, seq long, token string"))
    want = sorted((r["session_id"], r["number"], r["style"], r["sentence"]) for r in batch.collect())
    stream = spark.readStream.schema("session_id string, turn long, seq long, token string").option("maxFilesPerTrigger", 1).parquet(source)
    out, at = str(tmp_path / "out"), str(tmp_path / "at")
    sentences.stream_sentences(stream, idle_minutes=None).writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r["session_id"], r["number"], r["style"], r["sentence"]) for r in spark.read.parquet(out).collect())
    assert got == want


def test_session_stream(spark, tmp_path):
    from winnowry.streaming import session

    rows = [("s", k, "user" if k % 2 == 0 else "assistant", "x") for k in range(26)] + [("t", 0, "user", "x"), ("t", 1, "assistant", "y")]
    source = str(tmp_path / "messages")
    schema = "session_id string, turn long, role string, content string"
    for part in (rows[:10], rows[10:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = str(tmp_path / "out")
    session.stream_sessions(stream, ttl_minutes=None).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
    got = {(r["session_id"], r["archived"], r["kept"]) for r in spark.read.parquet(out).collect()}
    assert ("s", 10, 16) in got and ("t", 0, 2) in got


@pytest.mark.parametrize("limits", [(0, 4), (3, 4), (50, 0)])
def test_limits_are_checked(limits):
    with pytest.raises(ValueError):
        sentences.Splitter(*limits)


def test_each_token_gives_what_has_ended():
    splitter = sentences.Splitter()
    assert splitter.feed("你好") == [] and splitter.feed("呀。再") == ["你好呀。"] and splitter.flush() == ["再"]
    parser = sentences.StyleParser("温柔")
    assert parser.feed("【说话语") == "" and not parser.done
    assert parser.feed("气:倔强】谁说我小！") == "谁说我小！" and parser.style == "倔强"
    assert sentences.StyleParser("温柔").feed("你好。") == "你好。" and sentences.StyleParser("温柔").style == "温柔" and sentences.StyleParser("odd").style == "日常"


def test_tokens_one_by_one_lose_nothing():
    import random

    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("字a，。！ （）*[]\\\n") for _ in range(rng.randint(0, 200)))
        for tokens in (list(text), [text]):
            splitter = sentences.Splitter(12, 3)
            out = [x for t in tokens for x in splitter.feed(t)] + splitter.flush()
            assert "".join("".join(out).split()) == "".join(text.split())
            assert not splitter.text and not splitter.places


def test_a_long_turn_takes_linear_time():
    import time

    began = time.time()
    splitter = sentences.Splitter()
    got = [x for c in "字" * 40_000 for x in splitter.feed(c)] + splitter.flush()
    assert "".join(got) == "字" * 40_000 and time.time() - began < 10


def test_files_are_polled_once(spark, tmp_path):
    from winnowry.streaming import chain

    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    for part in range(2):
        spark.createDataFrame([(part,)], "k int").write.mode("append").json(source)
        chain.run_available(chain.poll(spark, source, "k int"), out, mark)
        assert sorted(r["k"] for r in spark.read.parquet(out).collect()) == list(range(part + 1))


def test_a_failing_sentence_is_its_own_error(spark):
    from winnowry.streaming.chain import speech_events

    def synthesise(batch):
        if (batch == "bad").any():
            raise ValueError("no voice for this")
        return ["audio of " + x for x in batch]

    rows = spark.createDataFrame([("s", 1, k, x) for k, x in enumerate(["one", "bad", "two"])], "session_id string, turn long, number int, sentence string").coalesce(1)
    got = [(r["type"], r["text"], r["audio"]) for r in speech_events(rows, synthesise).collect()]
    assert got == [
        ("sentence", "one", None), ("audio", None, "audio of one"), ("sentence", "bad", None), ("audio_error", "ValueError: no voice for this", None),
        ("sentence", "two", None), ("audio", None, "audio of two"),
    ]


def test_late_tokens_go_on_counting(spark, tmp_path):
    import time

    source, schema = str(tmp_path / "tokens"), "session_id string, turn long, seq long, token string"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    put([("s", 0, 0, "你好世界。"), ("s", 0, 1, "还没说完")])
    stream = spark.readStream.schema(schema).parquet(source)
    out = str(tmp_path / "out")
    run = sentences.stream_sentences(stream, idle_minutes=8 / 60).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "at")).trigger(processingTime="100 milliseconds").start()
    try:
        end = time.time() + 120
        while time.time() < end and not (run.lastProgress and spark.read.schema(sentences.SENTENCES).parquet(out).count() == 2):
            time.sleep(0.3)
        put([("s", 0, 2, "后来的话。")])
        while time.time() < end and spark.read.schema(sentences.SENTENCES).parquet(out).count() < 3:
            time.sleep(0.3)
    finally:
        run.stop()
    got = sorted((r["number"], r["sentence"]) for r in spark.read.schema(sentences.SENTENCES).parquet(out).collect())
    assert got[:2] == [(0, "你好世界。"), (1, "还没说完")] and [x for _, x in got[2:]] == ["后来的话。"]
