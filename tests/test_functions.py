"""Text, date, number and speech functions against golden cases."""
import pytest
from pyspark.sql import functions as F

from winnowry.functions import dates, numeric, similarity, speech
from winnowry.functions import text as T


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items())).select(column).first()[0]


@pytest.mark.parametrize(
    "text, lang, reason",
    [
        ("こんにちは、今日も配信だよ", "ja", None), ("大家好今天也来直播啦", "zh", None), ("やばいやばいやばいやばい", "ja", "phrase_loop"), ("什么什么什么什么白菜", "zh", "phrase_loop"),
        ("啊啊啊啊啊啊啊啊", "zh", "repetitive_char"), ("알아요. 가요", "zh", "hangul"), ("I love youI love you", "ja", "script_mismatch"), ("NANANANANANANANANANA", "zh", "script_mismatch"),
        ("ん〜〜〜〜〜〜〜〜〜", "ja", "nonlexical"), ("BGM", "ja", "ja_without_jp_script"), ("5.20M", "zh", "zh_without_cjk"), ("努力!未来!A beautiful star!", "ja", "latin_heavy"),
    ],
)
def test_quality_reasons(spark, text, lang, reason):
    found = one(spark, T.quality_reasons(F.col("t"), F.col("l")), t=text, l=lang)
    assert (found == []) if reason is None else (reason in found)


@pytest.mark.parametrize("text, repetitive", [("啊啊啊啊啊", True), ("哈哈哈你好", True), ("哈 哈 呀", True), ("哈哈你好", False), ("正常文本", False), ("", False), ("   ", False), (None, False)])
def test_char_repetition(spark, text, repetitive):
    assert one(spark, T.is_char_repetitive(F.col("t")), t=text) is repetitive


def test_era_and_names(spark):
    assert one(spark, T.era_tag(F.col("t")), t="live_2021_x") == "peak"
    assert one(spark, T.era_tag(F.col("t")), t="2012 2025") == "late"
    assert one(spark, T.era_tag(F.col("t")), t="x") == "unknown"
    assert one(spark, T.source_id(F.col("t")), t="a/BV1xyz_p1.wav") == "BV1xyz"
    assert one(spark, T.source_stem(F.col("t")), t="a/name_(Vocals)_1.wav") == "name"
    assert one(spark, T.source_stem(F.col("t")), t="a/name.wav") is None
    assert one(spark, T.slice_offsets(F.col("t")).getField("end"), t="x__0000032000_0000064000.wav") == 2.0


def test_dates(spark):
    assert str(one(spark, dates.stream_date(F.col("t"), F.lit(0)), t="2026年4月22日 杂谈")) == "2026-04-22"
    assert one(spark, dates.stream_date(F.col("t"), F.lit(0)), t="2026-13-45") is None
    assert one(spark, dates.plan_date(F.col("t")), t="2026-13-45") == "2026-13-45"
    assert one(spark, dates.parse_duration(F.col("t")), t="1:02:03") == 3723
    assert one(spark, dates.parse_duration(F.col("t")), t="live") == 0


def test_numbers(spark):
    assert one(spark, numeric.finite(F.col("t")), t="nan") is None
    assert one(spark, numeric.clamp(F.lit(3.0)), t="x") == 1.0
    run = one(spark, numeric.longest_run(F.expr("array(true, true, false, true, true)")), t="x")
    assert (run["start"], run["length"]) == (0, 2)
    assert one(spark, numeric.quantile_of(F.expr("array(1D, 2D, 4D)"), 0.25), t="x") == 1.5


def test_similarity(spark):
    assert one(spark, similarity.similarity_ratio(F.col("a"), F.col("b")), a="tide", b="diet") == 0.25
    assert one(spark, similarity.similarity_ratio(F.col("a"), F.col("b")), a="diet", b="tide") == 0.5
    assert one(spark, similarity.similarity_ratio(F.col("a"), F.col("b")), a=" ", b=None) == 1.0
    assert one(spark, similarity.char_error_rate(F.col("a"), F.col("b")), a="你好世界", b="你好世") == 0.25
    assert one(spark, similarity.nfkc_key(F.col("a")), a="Ａ ｂ") == "ab"


@pytest.mark.parametrize(
    "text, spoken",
    [
        ("【说话语气：元气】你好呀", "你好呀"), ("（微笑）你好(2026)", "你好2026"), ("*点头* 好的！", "好的！"), ("**重要** [链接](http://x)", "重要链接"), ("😀😀", None), ("  ", None), (None, None),
        ("花音：你 好", "你好"), ("```code```嗯", "嗯"), ("好的（小声", "好的"),
    ],
)
def test_speech(spark, text, spoken):
    assert one(spark, speech.normalize_speech_text(F.col("t")), t=text) == spoken


@pytest.mark.parametrize("text, want", [("结果（1+1=2）好", "结果1+1=2好"), ("看（a=b）吧", "看a=b吧"), ("甲（乙,丙）丁", "甲乙,丙丁"), ("说（笑着）话", "说话"), ("（旁白）开始", "开始"), ("{x=1}", "x=1")])
def test_brackets_with_signs_keep_their_words(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(speech.normalize_speech_text(F.col("t"))).first()[0]
    assert got.replace(" ", "") == want


def test_each_cue_is_needed():
    """A cue that another one holds, or that no direction would say, doesn't belong in the list."""
    assert all(cue.isalpha() for cue in speech.CUES)
    assert all(speech.reads_as_direction(cue) for cue in (*speech.CUES, *speech.WHOLE_CUES))
    assert not any(speech.reads_as_direction(x) for x in ("=", "(", "a=b", "1,2", "CUE", "meaning"))
