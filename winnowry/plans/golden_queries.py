"""Queries over fixed cases whose right answers are written out, for functions that SQL can't express, and round trips through files."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnowry.config import ConsensusLimits
from winnowry.functions import dates, similarity, speech
from winnowry.functions import text as T
from winnowry.operators import consensus, corrections, gates, retrieval
from winnowry.plans.corpus_queries import table
from winnowry.sources import readers, scratch, sinks
from winnowry.streaming import chain, sentences, session

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def literal(value) -> str:
    if value is None:
        return "NULL"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def rows_sql(columns: str, rows: list[tuple]) -> str:
    """The right answers as SQL."""
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + f") AS t({columns})"


#: Texts and what is to be spoken of them.
SPEECH = [
    ("（脸红）*轻轻点头*你好呀！💕", "你好呀！"), ("【说话语气:温柔】谢谢尼们。", "谢谢尼们。"), ("你好。（心里想着：今天也见到你了。）真的很开心哦！", "你好。真的很开心哦！"),
    ("新版本（2026）发布啦。", "新版本2026发布啦。"), ("花音：**欢迎**来[我的主页](https://example.com)！", "欢迎来我的主页！"), ("（害羞地低下头）💕……", None), ("你好。*轻轻点头", "你好。"),
    ("plain words", "plain words"), ("a (nod (deeply)) b", "a b"), ("一 二 three", "一二 three"), ("```x = 1```好的", "好的"), ("", None), ("<b>hi</b>你好", "你好"),
]


@query(rows_sql("k, spoken", [(k, s) for k, (_, s) in enumerate(SPEECH)]))
def q_speech_golden(spark, d):
    rows = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(SPEECH)], "k int, text string")
    return rows.select("k", speech.normalize_speech_text(F.col("text")).alias("spoken"))


#: Tokens of a turn, limits, the sentences and the style.
TURNS = [
    (["你好", "呀。"], 50, 4, ["你好呀。"], "日常"), (["你好。我是花音。"], 50, 4, ["你好。我是花音。"], "日常"), (["还没说完"], 50, 4, ["还没说完"], "日常"), (["好棒！真的吗？"], 50, 4, ["好棒！真的吗？"], "日常"),
    (["第一行\n第二行"], 50, 4, ["第一行\n第二行"], "日常"), (["你好呀，我最近很开心呢"], 5, 4, ["你好呀，", "我最近很开心呢"], "日常"), (["abcdefghijklmnopqrstu"], 10, 2, ["abcdefghijklmnopqrst", "u"], "日常"),
    (["（心里想着：你好。", "）今天也要加油！"], 50, 4, ["（心里想着：你好。）今天也要加油！"], "日常"), (["（心里想着今天见到你真的非常开心", "）你好。"], 5, 4, ["（心里想着今天见到你真的非常开心）你好。"], "日常"),
    (["（轻轻点头，露出微笑）你好呀"], 5, 4, ["（轻轻点头，露出微笑）你好呀"], "日常"), (["嗯。", "我记住啦！"], 50, 4, ["嗯。我记住啦！"], "日常"), (["前半段没有停顿直到这里，后半段继续"], 10, 2, ["前半段没有停顿直到这里，", "后半段继续"], "日常"),
    (["【说话语", "气:倔强】谁说我小！", "我是大大的。"], 50, 4, ["谁说我小！", "我是大大的。"], "倔强"), (["说话语气:惊讶\n诶？真的吗？"], 50, 4, ["诶？真的吗？"], "惊讶"), (["你好呀，今天也好元气～"], 50, 4, ["你好呀，今天也好元气～"], "日常"),
]


@query(rows_sql("turn, number, style, sentence", [(k, j, style, x) for k, (_, _, _, out, style) in enumerate(TURNS) for j, x in enumerate(out)]))
def q_sentence_golden(spark, d):
    """Turns of tokens, each kind of limits in one call."""
    parts: DataFrame | None = None
    for limits in sorted({(most, least) for _, most, least, _, _ in TURNS}):
        tokens = [("s", k, j, t) for k, (ts, most, least, _, _) in enumerate(TURNS) if (most, least) == limits for j, t in enumerate(ts)]
        out = sentences.split_turns(spark.createDataFrame(tokens, "session_id string, turn long, seq long, token string"), *limits)
        parts = out if parts is None else parts.unionByName(out)
    return parts.select("turn", "number", "style", "sentence")


@query(rows_sql("k, style, rest", [(0, "倔强", "哼，笨蛋。"), (1, "日常", "谢谢尼们。"), (2, "日常", "诶？"), (3, "日常", "你好。")]))
def q_style_golden(spark, d):
    rows = spark.createDataFrame([(0, "倔强", "【说话语气:俏皮】哼，笨蛋。"), (1, "低落", "[说话语气：温柔]谢谢尼们。"), (2, None, "说话语气:惊讶\n诶？"), (3, " 日常 ", "你好。")], "k int, style string, text string")
    return rows.select("k", speech.normalize_style(F.col("style")).alias("style"), speech.strip_style_prefix(F.col("text")).alias("rest"))


#: primary, secondary, third -> decision, tier, text, what was chosen, sim_ab, sim_ac, cer_ab.
TRANSCRIPTS = [
    (("你好，世界！", "你好世界", None), ("keep", "strict", "你好，世界！", "primary", 1.0, None, 0.0)),
    (("今天天气很好", "完全不同的话", None), ("drop", "drop_low_sim", None, None, 0.0, None, 1.0)),
    (("", " ", None), ("drop", "drop_empty", None, None, None, None, None)),
    (("只有一个", "", None), ("drop", "drop_no_pair", None, None, 0.0, None, None)),
    (("今天去公园玩了很开心啊", "今天去公园玩得很开心呀", "今天去公园玩了很开心啊"), ("drop", "drop_low_sim", None, None, 0.818182, 1.0, 0.181818)),
    (("我们今天一起去公园里散步吧", "我们今天一起去公园里散步啊", "我们今天一起去公园里散步吧"), ("keep", "strict", "我们今天一起去公园里散步吧", "primary", 0.923077, 1.0, 0.076923)),
    (("今天去公园玩很开心啊", "今天去公园玩很开心呀", "今天去公园玩很开心呀"), ("keep", "soft_third", "今天去公园玩很开心呀", "secondary_third", 0.9, 0.9, 0.1)),
]


@query(rows_sql("k, decision, tier, final_text, chosen, sim_ab, sim_ac, cer_ab", [(k, *want) for k, (_, want) in enumerate(TRANSCRIPTS)]).replace("SELECT *", "SELECT k, decision, tier, final_text, chosen, sim_ab::DOUBLE AS sim_ab, sim_ac::DOUBLE AS sim_ac, cer_ab::DOUBLE AS cer_ab"))
def q_consensus_golden(spark, d):
    rows = spark.createDataFrame([(k, *texts, None, None) for k, (texts, _) in enumerate(TRANSCRIPTS)], "k int, primary string, secondary string, third string, primary_logprob double, secondary_logprob double")
    out = consensus.adjudicate(rows, ConsensusLimits())
    return out.select("k", "decision", "tier", "final_text", "chosen", *[F.round(c, 6).alias(c) for c in ("sim_ab", "sim_ac", "cer_ab")])


@query(rows_sql("k, text, source", [(0, "这是一句比较完整的话", "primary_longer"), (1, "这是一句比较完整的话", "secondary_longer"), (2, "你好啊。", "primary_logprob"), (3, "你好啊！", "secondary_logprob"), (4, "你好啊。", "primary"), (5, "你好", "secondary"), (6, "你好", "primary")]))
def q_pick_text(spark, d):
    rows = spark.createDataFrame([(0, "这是一句比较完整的话", "这是一句", None, None), (1, "这是一句", "这是一句比较完整的话", None, None), (2, "你好啊。", "你好啊！", -0.1, -0.2), (3, "你好啊。", "你好啊！", -0.2, -0.1), (4, "你好啊。", "你好啊！", -0.1, -0.12), (5, "。", "你好", None, None), (6, "你好", "", None, None)], "k int, a string, b string, x double, y double")
    picked = consensus.pick_text(*map(F.col, "abxy"))
    return rows.select("k", picked["text"].alias("text"), picked["source"].alias("source"))


@query(rows_sql("k, decision, text_new", [(0, "keep", "二号文本很好"), (1, "keep", "一号文本很好"), (2, "drop", None), (3, "no_pass3", None), (4, "keep", "这个文本很好")]))
def q_third_pass(spark, d):
    rows = spark.createDataFrame([(0, "一号文本很好", "二号文本很好", "二号文本很好。"), (1, "一号文本很好", "别的东西", "一号文本很好"), (2, "甲乙丙丁", "戊己庚辛", "子丑寅卯"), (3, "一", "二", None), (4, "x", "這個文本很好", "這個文本很好")], "k int, text1 string, text2 string, text3 string")
    return consensus.third_pass(rows).select("k", "decision", "text_new")


@query(rows_sql("k, tier, decision, final_text", [(0, "strict", "keep", "今天天气真好啊"), (1, "drop_no_funasr", "drop", None), (2, "drop_no_whisper", "drop", None), (3, "drop_text_quality", "drop", None)]))
def q_build_consensus(spark, d):
    rows = spark.createDataFrame([(0, "zh", "今天天气真好啊", "今天天气真好啊。", True, True), (1, "zh", "今天天气真好啊", None, True, False), (2, "zh", None, "今天天气真好啊", False, True), (3, "zh", "啊啊啊啊啊啊啊啊", "啊啊啊啊啊啊啊啊", True, True)], "k int, lang string, text_1 string, text_2 string, has_1 boolean, has_2 boolean")
    out = consensus.build_consensus(rows.withColumns({"logprob_1": F.lit(None).cast("double"), "logprob_2": F.lit(None).cast("double")}))
    return out.select("k", "tier", "decision", "final_text")


@query(rows_sql("k, text", [(0, "今天很好呀"), (1, "今天很好"), (2, "今天很好")]))
def q_corrections_golden(spark, d):
    rows = spark.createDataFrame([(0, "今天很好", "今天很好呀"), (1, "今天很好", "完全不同"), (2, "今天很好", " ")], "k int, old string, new string")
    return rows.select("k", similarity.accept_correction(F.col("old"), F.col("new")).alias("text"))


@query(rows_sql("batch, place, corrected", [(0, 0, "你好世界啊"), (0, 1, "再见世界"), (0, 2, "天气很好"), (1, 0, "不变的话"), (2, 0, "说了一句话吧")]))
def q_correction_batches(spark, d):
    """Answers in a code fence, without one, with missing and far-off texts, and one that isn't JSON."""
    rows = spark.createDataFrame([(0, 0, "你好世界"), (0, 1, "再见世界"), (0, 2, "天气很好"), (1, 0, "不变的话"), (2, 0, "说了一句话")], "batch int, place int, text string")
    answers = [(0, '```json\n{"results": [{"index": 0, "text": "你好世界啊"}, {"index": 2, "text": "完全不同的东西"}]}\n```'), (1, "sorry"), (2, '{"results": [{"index": 0, "text": "说了一句话吧"}]}')]
    return corrections.apply_answers(rows, spark.createDataFrame(answers, "batch int, content string")).select("batch", "place", "corrected")


@query(rows_sql("query_id, text, rank", [(1, "你好呀大家", 1), (1, "早上好", 2), (3, "你好呀大家", 1), (3, "こんにちは", 2), (3, "早上好", 3), (4, "今天吃什么", 2), (4, "好吃", 1)]))
def q_fewshot_golden(spark, d):
    """Examples of the matched scenes; where fewer than three were found the pool would fill up, so its other lines are kept out by their era."""
    lines = lambda rows: spark.createDataFrame(rows, "ordinal int, text string, lang string, scenes array<string>, era_tag string")
    official = lines([(1, "你好呀大家", "zh", ["问候"], None), (2, "谢谢你们", "zh", ["感谢"], None), (3, "こんにちは", "ja", ["问候"], None)])
    fan = lines([(1, "早上好", "zh", ["问候"], None), (2, "好吃", "zh", ["食物"], None)])
    pool = lines([(1, "今天吃什么", "zh", ["食物"], "peak"), (2, "再见啦", "zh", ["告别"], "late"), (3, "我们开始吧", "zh", ["游戏"], "late")])
    asked = spark.createDataFrame([(1, "你好"), (3, "こんにちは"), (4, "好吃的饭")], "query_id int, text string")
    got = retrieval.pick_examples(asked, official, fan, pool, 7)
    return got.where("NOT (text = '今天吃什么' AND query_id <> 4)").select("query_id", "text", "rank")


@query(rows_sql("k, scenes, allowed", [(0, "问候", False), (1, "告别", True), (2, "游戏,食物", False), (3, "", False)]).replace("allowed)", "allowed)"))
def q_scenes_golden(spark, d):
    rows = spark.createDataFrame([(0, "你好"), (1, "拜拜啦"), (2, "ＬＯＬ完吃饭"), (3, "窗外")], "k int, text string")
    scenes = retrieval.matched_scenes(F.col("text"))
    return rows.select("k", F.array_join(scenes, ",").alias("scenes"), retrieval.era_allowed(F.lit("late"), scenes).alias("allowed"))


@query(rows_sql("k, text", [(0, "forced text of words"), (1, "日本日本 words"), (2, "日本日本 words")]))
def q_swapped_text(spark, d):
    """A forced transcript replaces one of another script only where similarity is middling."""
    rows = spark.createDataFrame([(0, "en", "日本日本 words", "forced text of words", 0.6), (1, "en", "日本日本 words", "forced text of words", 0.8), (2, "en", "日本日本 words", "xx xx xx xx xx xx xx xx", 0.6)], "k int, lang string, text string, forced_text string, similarity double")
    return rows.select("k", gates.swapped_text().alias("text"))


@query(rows_sql("k, text", [(0, "你好世界"), (1, "a b"), (2, "one two")]))
def q_joined_parts(spark, d):
    rows = spark.createDataFrame([(0, "zh", [" 你好", "", "世界 "]), (1, "en", ["a", None, " b"]), (2, "", ["one ", " two"])], "k int, lang string, parts array<string>")
    return rows.select("k", T.joined_parts(F.col("parts"), F.col("lang")).alias("text"))


@query(rows_sql("k, text", [(0, "汉语们"), (1, "abc")]))
def q_character_map(spark, d):
    pairs = T.character_map(spark.createDataFrame([("漢", "汉"), ("語", "语"), ("們", "们")], "traditional string, simplified string"))
    return spark.createDataFrame([(0, "漢語們"), (1, "abc")], "k int, text string").select("k", T.to_simplified(F.col("text"), *pairs).alias("text"))


@query(rows_sql("k, day", [(0, "2024-01-05"), (1, "2026-04-22"), (2, None)]))
def q_record_dates(spark, d):
    rows = spark.createDataFrame([(0, "nothing", 1704412800), (1, "2026-04-22 杂谈", 0), (2, "nothing", 0)], "k int, title string, pubdate long")
    return rows.select("k", dates.record_date(F.col("title"), F.col("pubdate")).cast("string").alias("day"))


@query(rows_sql("k, id", [(0, "BV1234567890"), (1, "BV1234567890"), (2, "BVabcdefghij")]))
def q_source_ids(spark, d):
    rows = spark.createDataFrame([(0, " bv1234567890"), (1, "1234567890"), (2, "BVabcdefghij")], "k int, id string")
    return rows.select("k", T.normalize_source_id(F.col("id")).alias("id"))


@query("SELECT conv_id AS session_id FROM (SELECT conv_id, max(turn) AS last_used, row_number() OVER (ORDER BY max(turn), conv_id) AS rn FROM conversations WHERE conv_id % 4 <> 0 GROUP BY conv_id) WHERE rn <= (SELECT count(DISTINCT conv_id) FROM conversations) - 60")
def q_evicted_sessions(spark, d):
    held = F.when(F.col("session_id") % 8 == 0, 1).otherwise(0)
    rows = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("session_id")).agg(F.max("turn").alias("last_used"))
    return session.to_evict(rows.withColumns({"reservations": held, "locked": F.col("session_id") % 8 == 4}), 60)


@query("SELECT event_id AS request_id, event_id % 3 AS attempt, 1::BIGINT AS ordinal, event_type AS delta FROM events")
def q_answering_attempt(spark, d):
    """Requests whose first attempts bring no delta; the attempt after the answering one isn't read."""
    rows = table(spark, d, "events").select(F.col("event_id").alias("request_id"), "event_type", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("attempt"))
    fails = F.col("attempt") < F.col("request_id") % 3
    delta = F.concat(F.lit('data: {"delta": {"text": "'), "event_type", F.lit('"}}'))
    lines = rows.select("request_id", F.col("attempt").cast("long").alias("attempt"), F.lit(1).cast("long").alias("ordinal"), F.when(fails, "error 503").otherwise(delta).alias("value"))
    return readers.answering_attempt(lines)


@query("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id % 2 = 0")
def q_json_round_trip(spark, d):
    """A table through JSON lines, and through one JSON array."""
    rows = table(spark, d, "documents").select("doc_id", "lang", "n_chars").where("doc_id % 2 = 0")
    lines, array = scratch.scratch_path(spark, "lines"), scratch.scratch_path(spark, "array")
    rows.write.json(lines)
    rows.limit(5).agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value")).coalesce(1).write.text(array)
    few = readers.read_json_list(spark, array, "doc_id long, lang string, n_chars long")
    items = readers.read_items(spark, array, "doc_id long, lang string, n_chars long", strict=True).drop("ordinal")
    return readers.read_json_list(spark, lines, "doc_id long, lang string, n_chars long", lines=True).unionByName(few).unionByName(items).distinct()


@query("SELECT doc_id - (SELECT min(doc_id) FROM documents) AS ordinal, 'line ' || doc_id AS value FROM documents WHERE (SELECT max(doc_id) - min(doc_id) + 1 = count(*) FROM documents)")
def q_lines_round_trip(spark, d):
    """Lines of several files of several splits, by the order of file names."""
    path = scratch.scratch_path(spark, "text")
    rows = table(spark, d, "documents").select("doc_id", F.concat(F.lit("line "), "doc_id").alias("value"))
    rows.repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id").select("value").write.text(path)
    return readers.read_lines(spark, path)


@query("SELECT doc_id, 'a' AS title FROM documents WHERE doc_id = 0")
def q_document_round_trip(spark, d):
    path = scratch.scratch_path(spark, "document")
    table(spark, d, "documents").where("doc_id = 0").select(F.to_json(F.struct("doc_id", F.lit("a").alias("title"))).alias("value")).coalesce(1).write.text(path)
    found = readers.read_document(spark, path, "doc_id long, title string")
    return found.unionByName(readers.read_document(spark, path + "-missing", "doc_id long, title string"))


@query("SELECT count(*) > 0 AS found, true AS named, true AS sized FROM (SELECT 1)")
def q_list_files(spark, d):
    path = scratch.scratch_path(spark, "files")
    table(spark, d, "documents").select("doc_id").write.parquet(path)
    files = readers.list_files(spark, path, ".parquet", "part-")
    return files.agg((F.count(F.lit(1)) > 0).alias("found"), F.bool_and(F.col("name").endswith(".parquet")).alias("named"), F.bool_and(F.col("size") > 0).alias("sized"))


@query("SELECT count(*) AS n, 1.0::DOUBLE AS least, 1.0::DOUBLE AS most FROM embeddings")
def q_read_embeddings(spark, d):
    rows = readers.read_embeddings(spark, f"{d}/embeddings.parquet", "vec_id", "embedding")
    norm = F.round(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)), 9)
    return rows.select(norm.alias("norm")).agg(F.count(F.lit(1)).alias("n"), F.min("norm").alias("least"), F.max("norm").alias("most"))


@query("""SELECT 'manifest' AS part, count(*) AS n FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT 'dropped', count(*) FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT 'report', 2
UNION ALL SELECT 'dataset', count(*) FROM documents WHERE doc_id % 5 = 0 UNION ALL SELECT 'annotation', count(*) FROM documents WHERE doc_id % 5 = 0 UNION ALL SELECT 'listen', 10""")
def q_sinks_round_trip(spark, d):
    """Row counts of what the sinks wrote."""
    docs = table(spark, d, "documents")
    out = scratch.scratch_path(spark, "sinks")
    sinks.split_decisions(docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "drop").otherwise("keep").alias("decision"), F.when(F.col("doc_id") % 3 == 0, "drop_x").otherwise("strict").alias("tier")), out)
    selected = docs.where("doc_id % 5 = 0").select("lang", F.regexp_replace("text", r"[\r\n]", " ").alias("text"), F.col("n_chars").cast("double").alias("score"), F.col("doc_id").cast("string").alias("path"))
    sinks.write_dataset(selected, f"{out}/set", "h")
    sinks.listen_pack(docs.orderBy("doc_id").limit(10).select("doc_id", "text"), f"{out}/listen")
    read, count = spark.read, lambda rows, part: rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), "n")
    parts = [count(read.parquet(f"{out}/manifest"), "manifest"), count(read.json(f"{out}/dropped"), "dropped"), count(read.json(f"{out}/report"), "report"), count(read.parquet(f"{out}/set/manifest"), "dataset"),
             count(read.text(f"{out}/set/annotation"), "annotation"), count(read.csv(f"{out}/listen", sep="\t", header=True), "listen")]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


@query(rows_sql("turn, index, type, text, audio", [(0, 0, "sentence", "你好世界。", None), (0, 0, "audio", None, "<你好世界。>"), (0, 1, "sentence", "今天很好！", None), (0, 1, "audio", None, "<今天很好！>"), (1, 0, "sentence", "错误错误。", None), (1, 0, "audio_error", None, None)]))
def q_speech_chain(spark, d):
    """The chain of a turn as a stream over files that ends with its input: tokens to sentences to audio events."""
    turns = {0: "你好世界。今天很好！", 1: "错误错误。"}
    tokens = [("s", t, k, c) for t, text in turns.items() for k, c in enumerate([*text, "\0"])]
    source, out, mark = (scratch.scratch_path(spark, x) for x in ("tokens", "events", "mark"))
    spark.createDataFrame(tokens, "session_id string, turn long, seq long, token string").coalesce(1).write.json(source)
    stream = chain.poll(spark, source, "session_id string, turn long, seq long, token string")
    chain.run_available(chain.speak(stream, lambda xs: [None if "错" in x else f"<{x}>" for x in xs], idle_minutes=None), out, mark)
    return spark.read.parquet(out).select("turn", "index", "type", "text", "audio")
