"""Rules that the fixtures show on single rows, run on whole tables, with SQL of their own."""
from __future__ import annotations

from pyspark.sql import functions as F

from winnowry.functions import dates, numeric, speech
from winnowry.functions import text as T
from winnowry.operators import aggregates, catalog, consensus, corrections, gates, joins, retrieval
from winnowry.plans import fixture_queries, sql
from winnowry.plans.corpus_queries import table
from winnowry.plans.stage_queries import client_events
from winnowry.sources import readers, scratch, sinks
from winnowry.streaming import session

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


_FLAT = "translate(coalesce(text, ''), chr(10) || chr(13), '  ')"


@query(f"""SELECT doc_id AS ordinal, 'd/' || doc_id || '.wav' AS path, doc_id || '.wav' AS name, CASE WHEN doc_id % 3 = 0 THEN 'ja' ELSE 'zh' END AS lang, md5({_FLAT} || '|' || lang) AS digest FROM documents WHERE doc_id % 7 <> 0""")
def q_annotation_table(spark, d):
    """An annotation line per document, read back; each seventh is broken."""
    text = F.translate(F.coalesce("text", F.lit("")), "\n\r", "  ")
    tag = F.when(F.col("doc_id") % 3 == 0, F.when(F.col("doc_id") % 2 == 0, "JP").otherwise("ja")).otherwise("ZH")
    line = F.when(F.col("doc_id") % 7 == 0, F.lit("broken|h|JP")).otherwise(F.concat_ws("|", F.concat(F.lit("d/"), "doc_id", F.lit(".wav")), F.lit("h"), tag, text, F.col("lang")))
    rows = readers.parse_annotation(table(spark, d, "documents").select(F.col("doc_id").alias("ordinal"), line.alias("value")))
    return rows.select("ordinal", "path", "name", "lang", F.md5("text").alias("digest"))


_CLIP = "CAST(n_chars % 400 / 10.0 AS DOUBLE) AS duration, CAST(-(doc_id % 50) AS DOUBLE) AS rms_db, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE CAST((doc_id % 21) / 20.0 AS DOUBLE) END AS voiced_ratio, CASE WHEN doc_id % 17 = 0 THEN NULL ELSE CAST((doc_id % 9) / 40.0 AS DOUBLE) END AS f0_cv, CAST((doc_id % 11) / 2.0 AS DOUBLE) AS longest_voiced, CASE WHEN doc_id % 5 = 0 THEN 'singing' END AS reason"


@query(f"""SELECT doc_id, CASE WHEN NOT duration BETWEEN 1.5 AND 30 THEN 'duration' WHEN rms_db < -40 THEN 'low_energy' WHEN longest_voiced > 3 OR coalesce(voiced_ratio, 0) > 0.75 AND coalesce(f0_cv, 1) < 0.15 THEN 'singing' END AS gate,
CASE WHEN voiced_ratio IS NULL OR f0_cv IS NULL THEN reason IS NOT NULL ELSE voiced_ratio > 0.75 AND f0_cv < 0.15 AND longest_voiced > 3 END AS sings FROM (SELECT doc_id, {_CLIP} FROM documents)""")
def q_acoustic_table(spark, d):
    rows = table(spark, d, "documents").selectExpr("doc_id", *_split(_CLIP))
    return rows.select("doc_id", gates.acoustic_reason().alias("gate"), gates.is_singing().alias("sings"))


def _split(columns: str) -> list[str]:
    """Columns of a select list, parted at commas outside brackets."""
    out, depth, low = [], 0, 0
    for k, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(columns[low:k])
            low = k + 1
    return [*out, columns[low:]]


_PART = "doc_id % 10 <> 0 AS present, n_chars % 120 AS size, CASE doc_id % 3 WHEN 0 THEN 0 ELSE 100 END AS total_size, CAST((doc_id % 5) * 5 AS DOUBLE) AS expected, CAST((doc_id % 47) / 2.0 AS DOUBLE) AS decoded, doc_id % 4 <> 0 AS clean"


@query(f"""WITH p AS (SELECT doc_id, {_PART} FROM documents), r AS (SELECT *, CASE WHEN expected > 0 THEN decoded / expected ELSE 0 END AS share, CASE WHEN total_size > 0 THEN size / total_size::DOUBLE END AS got FROM p),
s AS (SELECT doc_id, present, size = 0 OR got > 1 OR share > 1.02 AS broken, clean AND CASE WHEN expected > 0 THEN share >= 0.98 ELSE coalesce(got, 0) = 1 END AS whole,
    coalesce(got, 0) = 1 OR (got > 0.05 AND expected > 0 AND share + 0.08 < got) OR (total_size = 0 AND NOT clean) OR (NOT clean AND decoded = 0) AS odd FROM r)
SELECT doc_id, CASE WHEN NOT present THEN 'missing' WHEN broken THEN 'invalid' WHEN whole THEN 'complete' WHEN odd THEN 'invalid' ELSE 'resumable' END AS state FROM s""")
def q_part_state_table(spark, d):
    return table(spark, d, "documents").selectExpr("doc_id", *_split(_PART)).select("doc_id", gates.part_state().alias("state"))


_SEG = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_returnflag || l_linestatus AS text, CAST(l_quantity / 10 AS DOUBLE) AS a, CAST(l_quantity / 10 + l_discount * 20 AS DOUBLE) AS b, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE CAST(-l_tax AS DOUBLE) END AS lp, CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE CAST(l_discount AS DOUBLE) END AS ns, CAST(l_tax AS DOUBLE) AS cr"


@query(f"""SELECT l_orderkey, trim(string_agg(text, '' ORDER BY l_linenumber, l_partkey, l_suppkey, a)) AS text, round(sum(greatest(b - a, 0.01) * lp) / sum(greatest(b - a, 0.01)) FILTER (WHERE lp IS NOT NULL), 9) AS avg_logprob, max(ns) AS max_no_speech, max(cr) AS max_compression, count(*) AS n
FROM (SELECT {_SEG} FROM lineitem) GROUP BY 1""")
def q_segment_records(spark, d):
    """A record per order of its line items as segments."""
    rows = table(spark, d, "lineitem").selectExpr(*_split(_SEG))
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("a").alias("start"), F.col("b").alias("end"), "text", F.col("lp").alias("avg_logprob"), F.col("ns").alias("no_speech_prob"), F.col("cr").alias("compression_ratio"))
    r = rows.groupBy("l_orderkey").agg(aggregates.segment_record(F.sort_array(F.collect_list(item))).alias("r"))
    return r.select("l_orderkey", "r.text", F.round("r.avg_logprob", 9).alias("avg_logprob"), F.col("r.max_no_speech_probability").alias("max_no_speech"), F.col("r.max_compression_ratio").alias("max_compression"), F.col("r.segment_count").cast("long").alias("n"))


@query("""WITH f AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, value, value > 12 AS v FROM events),
g AS (SELECT *, i - row_number() OVER (PARTITION BY user_id, v ORDER BY i) AS k FROM f), r AS (SELECT user_id, k, count(*) AS n, min(i) AS first FROM g WHERE v GROUP BY 1, 2),
best AS (SELECT user_id, first, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) AS rn FROM r) WHERE rn = 1),
c AS (SELECT f.user_id, stddev_pop(value) / abs(avg(value)) AS cv FROM f JOIN best b ON f.user_id = b.user_id AND i >= first AND i < first + n WHERE event_id_ok GROUP BY 1)
SELECT a.user_id, round(count(*) FILTER (WHERE v) / count(*)::DOUBLE, 9) AS voiced_ratio, round(coalesce(max(n), 0) * 512 / 1024.0, 9)::DOUBLE AS longest_voiced, round(max(cv), 6) AS f0_cv FROM f a LEFT JOIN best b ON a.user_id = b.user_id LEFT JOIN c ON a.user_id = c.user_id GROUP BY 1""".replace(" WHERE event_id_ok", " WHERE value < 60"))
def q_frame_features_table(spark, d):
    """A track per user: pitch above 12 is voiced, from 60 on it isn't known."""
    frames = table(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "value"))).alias("f"))
    tracks = frames.select("user_id", F.transform("f", lambda x: F.when(x["value"] < 60, x["value"])).alias("f0"), F.transform("f", lambda x: x["value"] > 12).alias("voiced"), F.lit(1024).alias("sr"), F.lit(512).alias("hop"))
    rows = aggregates.frame_features(tracks)
    return rows.select("user_id", F.round("voiced_ratio", 9).alias("voiced_ratio"), F.round("longest_voiced", 9).alias("longest_voiced"), F.round("f0_cv", 6).alias("f0_cv"))


_ID = "CASE page_id % 3 WHEN 0 THEN 'BV' || lpad(page_id::VARCHAR, 10, 'a') WHEN 1 THEN lpad(page_id::VARCHAR, 10, 'b') ELSE 'bv' || lpad(page_id::VARCHAR, 10, 'c') END"


@query(f"""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN {_ID} ELSE '' END AS of_path, 'BV' || right({_ID}, 10) AS normal FROM pages""")
def q_recording_ids(spark, d):
    own = F.expr("CASE page_id % 3 WHEN 0 THEN concat('BV', lpad(page_id, 10, 'a')) WHEN 1 THEN lpad(page_id, 10, 'b') ELSE concat('bv', lpad(page_id, 10, 'c')) END")
    rows = table(spark, d, "pages").select("page_id", own.alias("own"))
    path = F.concat(F.lit("/x/BVno/"), "own", F.lit("_(Vocals).wav"))
    return rows.select("page_id", T.source_id(path).alias("of_path"), T.normalize_source_id(F.concat(F.lit(" "), "own")).alias("normal"))


@query("""SELECT doc_id, CASE WHEN kana AND NOT latin THEN 'ja' WHEN cjk AND NOT kana AND NOT latin THEN 'zh' WHEN latin AND NOT kana AND NOT cjk THEN 'en' ELSE 'auto' END AS lang FROM (SELECT doc_id, doc_id % 4 IN (1, 3) AS kana, doc_id % 4 IN (2, 3) AS cjk,
doc_id % 5 <> 0 AND regexp_matches(coalesce(text, ''), '[A-Za-z]') AS latin FROM documents)""")
def q_text_languages(spark, d):
    head = F.expr("CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'こんにちは' WHEN 2 THEN '你好' ELSE '今日は' END")
    text = F.concat(head, F.when(F.col("doc_id") % 5 == 0, "12!").otherwise(F.coalesce("text", F.lit(""))))
    return table(spark, d, "documents").select("doc_id", T.resolve_text_language(text).alias("lang"))


_STYLE = "list_extract(['日常', '元气', '温柔', '俏皮', '倔强', '惊讶', '未知'], (conv_id % 7 + 1)::INT)"


@query(f"""SELECT conv_id, turn, CASE WHEN conv_id % 7 = 6 THEN '日常' ELSE {_STYLE} END AS style, md5(CASE WHEN conv_id % 7 = 6 THEN '【说话语气：未知】' || coalesce(text, '') ELSE {sql.strip("coalesce(text, '')").replace("|" + sql.WS + "+$", "")} END) AS digest FROM conversations""")
def q_style_tags(spark, d):
    """A style tag before each message, in one of two forms; unknown styles aren't tags."""
    style = F.expr("element_at(array('日常', '元气', '温柔', '俏皮', '倔强', '惊讶', '未知'), CAST(conv_id % 7 + 1 AS INT))")
    said = F.coalesce("text", F.lit(""))
    line = (F.col("turn") % 2 == 1) & (F.col("conv_id") % 7 != 6)
    tagged = F.when(line, F.concat(F.lit("说话语气: "), style, F.lit("\n"), F.regexp_replace(said, r"(?U)^\s+", ""))).otherwise(F.concat(F.lit("【说话语气："), style, F.lit("】"), F.when(F.col("conv_id") % 7 == 6, said).otherwise(F.regexp_replace(said, r"(?U)^\s+", ""))))
    rows = table(spark, d, "conversations")
    return rows.select("conv_id", "turn", speech.normalize_style(F.concat(F.lit(" "), style)).alias("style"), F.md5(speech.strip_style_prefix(tagged)).alias("digest"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 0 ELSE n_chars END AS seconds FROM documents")
def q_duration_texts(spark, d):
    text = F.expr("CASE doc_id % 4 WHEN 0 THEN CAST(n_chars AS STRING) WHEN 1 THEN format_string('%d:%02d', n_chars DIV 60, n_chars % 60) WHEN 2 THEN format_string('%d:%02d:%02d', n_chars DIV 3600, n_chars DIV 60 % 60, n_chars % 60) ELSE 'live' END")
    return table(spark, d, "documents").select("doc_id", dates.parse_duration(text).alias("seconds"))


@query(f"""SELECT conv_id, md5(CASE WHEN conv_id % 3 < 2 THEN string_agg(p, '' ORDER BY turn) FILTER (WHERE p <> '') ELSE string_agg(p, ' ' ORDER BY turn) FILTER (WHERE p <> '') END) AS digest FROM (SELECT conv_id, turn, {sql.strip("text")} AS p FROM conversations) GROUP BY conv_id HAVING count(*) FILTER (WHERE p <> '') > 0""")
def q_joined_transcripts(spark, d):
    each = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.concat(F.lit(" "), F.coalesce("text", F.lit("")), F.lit("\t")).alias("t")))).alias("m"))
    lang = F.expr("CASE conv_id % 3 WHEN 0 THEN 'zh' WHEN 1 THEN 'ja' ELSE 'en' END")
    text = T.joined_parts(F.transform("m", lambda x: x["t"]), lang)
    return each.select("conv_id", text.alias("text")).where("text <> ''").select("conv_id", F.md5("text").alias("digest"))


@query("""SELECT session_id, turn, md5(coalesce(string_agg(CASE WHEN type = 'sentence' THEN 's' || event_id END, '' ORDER BY index, 's' || event_id), '')) AS digest, count(*) FILTER (WHERE type = 'audio') AS n_audio, count(*) FILTER (WHERE type = 'audio_error') AS n_failed, CASE WHEN bool_or(type = 'done') THEN 'done' ELSE 'open' END AS state
FROM (SELECT user_id AS session_id, event_id % 4 AS turn, (event_id // 4) % 6 AS index, CASE event_type WHEN 'click' THEN 'sentence' WHEN 'view' THEN 'audio' WHEN 'error' THEN 'audio_error' ELSE 'done' END AS type, event_id FROM events) GROUP BY 1, 2""")
def q_folded_events(spark, d):
    rows = session.fold_events(client_events(spark, d).withColumn("text", F.concat(F.lit("s"), "event_id")))
    return rows.select("session_id", "turn", F.md5("text").alias("digest"), "n_audio", "n_failed", "state")


_TITLES = ("杂谈 今天怎么样", "聊天", "切片 合集", "3D演唱会", "歌回 全程", "一起看 动画", "随便聊 唱", "学中文", "剪辑", "经典老番", "看演唱会", "歌回")
_CATALOG = f"""SELECT CASE WHEN doc_id % 97 = 0 THEN '' WHEN doc_id % 89 = 0 THEN 'BV1ReodBdEM1' ELSE 'BV' || (doc_id - doc_id % 3) END AS source_id,
CASE WHEN doc_id % 5 = 0 THEN '2026-' || (1 + doc_id % 12) || '-' || (1 + doc_id % 28) || ' ' WHEN doc_id % 5 = 1 THEN '2025年' || (1 + doc_id % 12) || '月' || (10 + doc_id % 9) ELSE '' END || list_extract([{", ".join(f"'{t}'" for t in _TITLES)}], (doc_id % {len(_TITLES)} + 1)::INT) AS title,
list_extract(['xun隐者不遇', 'SilverCreeper', '大前神', NULL, 'x'], (doc_id % 5 + 1)::INT) AS author, CAST(n_chars * 2 AS BIGINT) AS duration, 0::BIGINT AS pubdate, CASE WHEN doc_id % 8 = 0 THEN NULL ELSE doc_id * 1000 END::BIGINT AS play, doc_id AS ordinal FROM documents"""


@query(f"SELECT *, row_number() OVER (ORDER BY priority_score DESC, source_id, coalesce(stream_date, ''), tier) AS place FROM ({fixture_queries._PLAN.replace(fixture_queries.CATALOG, _CATALOG)})")
def q_catalog_table(spark, d):
    """The plan of a catalog as large as the documents, in its order."""
    title = F.expr("concat(CASE WHEN doc_id % 5 = 0 THEN concat('2026-', 1 + doc_id % 12, '-', 1 + doc_id % 28, ' ') WHEN doc_id % 5 = 1 THEN concat('2025年', 1 + doc_id % 12, '月', 10 + doc_id % 9) ELSE '' END, " + "element_at(array(" + ", ".join(f"'{t}'" for t in _TITLES) + f"), CAST(doc_id % {len(_TITLES)} + 1 AS INT)))")
    rows = table(spark, d, "documents").select(
        F.expr("CASE WHEN doc_id % 97 = 0 THEN '' WHEN doc_id % 89 = 0 THEN 'BV1ReodBdEM1' ELSE concat('BV', doc_id - doc_id % 3) END").alias("source_id"), title.alias("title"),
        F.expr("element_at(array('xun隐者不遇', 'SilverCreeper', '大前神', NULL, 'x'), CAST(doc_id % 5 + 1 AS INT))").alias("author"), (F.col("n_chars") * 2).cast("long").alias("duration"), F.lit(0).cast("long").alias("pubdate"),
        F.expr("CASE WHEN doc_id % 8 = 0 THEN NULL ELSE doc_id * 1000 END").cast("long").alias("play"), F.col("doc_id").alias("ordinal"),
    )
    plan = catalog.build_plan(rows).withColumn("priority_score", F.round("priority_score", 9))
    placed = catalog.in_priority_order(plan)
    return placed.select("source_id", "tier", "lang_hint", F.array_join("risk", ",").alias("risk"), "stream_date", "priority_score", "place")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 3 THEN NULL ELSE o_totalprice END AS value, CASE WHEN o_orderkey % 5 < 3 THEN NULL ELSE greatest(0.0, least(200000.0, o_totalprice)) END AS clamped FROM orders")
def q_finite_table(spark, d):
    text = F.expr("CASE o_orderkey % 5 WHEN 0 THEN 'nan' WHEN 1 THEN 'inf' WHEN 2 THEN 'x' ELSE CAST(o_totalprice AS STRING) END")
    x = numeric.finite(text)
    return table(spark, d, "orders").select("o_orderkey", x.alias("value"), numeric.clamp(x, 0.0, 200000.0).alias("clamped"))


# --- consensus, corrections, examples: texts whose similarity is known, as they are equal, share no character, or lose a known tail ----

_ALPHABET, _SHORTER, _OTHER = "abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstu", "ЖЖЩЖЩЩЖ"
_SAID = "SELECT conv_id * 1000 + turn AS k, conv_id, turn, coalesce(text, '') AS text FROM conversations"
_COMPACT = r"""regexp_replace({}, '[\s\x0b\x{{0085}}\x{{00A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}，。！？、；：…,.!?;:·~～\-_/\\|@#$%^&*+=<>()（）「」『』【】\[\]{{}}"''“”‘’]+', '', 'g')"""


@query(f"""WITH s AS ({_SAID}), e AS (SELECT k, k % 6 AS m, CASE WHEN k % 6 = 5 THEN '{_ALPHABET}' ELSE text END AS a, CASE k % 6 WHEN 0 THEN text WHEN 1 THEN '{_OTHER}' WHEN 3 THEN '.,' WHEN 4 THEN text || '!!' ELSE '{_SHORTER}' END AS b, k % 12 = 5 AS third FROM s),
n AS (SELECT *, length({_COMPACT.format("a")}) AS na FROM e),
t AS (SELECT k, CASE WHEN m = 2 THEN 'drop_no_funasr' WHEN m = 3 THEN CASE WHEN na = 0 THEN 'drop_empty' ELSE 'drop_no_pair' END WHEN na = 0 THEN CASE WHEN m IN (0, 4) THEN 'drop_empty' ELSE 'drop_no_pair' END WHEN m = 1 THEN 'drop_low_sim'
    WHEN m = 5 THEN CASE WHEN third THEN 'soft_third' ELSE 'drop_low_sim' END WHEN na < 2 THEN 'drop_empty' ELSE 'strict' END AS tier, {sql.strip("a")} AS final FROM n),
{sql.quality("SELECT k, final AS text, 'en' AS lang FROM t")},
u AS (SELECT t.k, CASE WHEN tier IN ('strict', 'soft_third') AND len(reasons) > 0 THEN 'drop_text_quality' ELSE tier END AS tier, final FROM t JOIN quality q ON q.k = t.k)
SELECT k, tier, CASE WHEN tier LIKE 'drop%' THEN 'drop' ELSE 'keep' END AS decision, CASE WHEN tier NOT LIKE 'drop%' THEN md5(final) END AS digest FROM u""")
def q_consensus_table(spark, d):
    """Three engines' transcripts of every message: equal ones, unequal ones, missing and empty ones, and pairs that need the third."""
    said = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), F.coalesce("text", F.lit("")).alias("text")).withColumn("m", F.col("k") % 6)
    name = F.concat(F.lit("n"), "k")
    engine = lambda text, keep: said.where(keep).select(name.alias("name"), F.lit("").alias("path"), text.alias("text"), F.lit(None).cast("double").alias("avg_logprob"), F.col("k").alias("ordinal"))
    second = F.when(F.col("m") == 0, F.col("text")).when(F.col("m") == 1, _OTHER).when(F.col("m") == 3, ".,").when(F.col("m") == 4, F.concat("text", F.lit("!!"))).otherwise(_SHORTER)
    first = F.when(F.col("m") == 5, _ALPHABET).otherwise(F.col("text"))
    rows = joins.engines(said.select("k", name.alias("name"), F.lit("en").alias("lang")), engine(first, F.lit(True)), engine(second, F.col("m") != 2), engine(F.lit(_ALPHABET), F.col("k") % 12 == 5))
    return consensus.build_consensus(rows).select("k", "tier", "decision", F.md5("final_text").alias("digest"))


@query(f"""WITH s AS ({_SAID}) SELECT k, CASE k % 4 WHEN 0 THEN 'no_pass3' WHEN 3 THEN 'drop' ELSE CASE WHEN length({_COMPACT.format("text")}) = 0 THEN 'drop' ELSE 'keep' END END AS decision,
CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN 1.0 WHEN 2 THEN 0.0 ELSE 0.0 END::DOUBLE AS sim13, CASE k % 4 WHEN 0 THEN NULL WHEN 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS sim23, CASE WHEN k % 4 IN (1, 2) THEN md5(text) END AS digest FROM s WHERE length({_COMPACT.format("text")}) > 0""")
def q_third_pass_table(spark, d):
    said = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), F.coalesce("text", F.lit("")).alias("text")).where(F.length(T.compact_text(F.col("text"))) > 0)
    m = F.col("k") % 4
    rows = said.select("k", F.when(m == 1, F.col("text")).otherwise(_OTHER).alias("text1"), F.when(m == 2, F.col("text")).otherwise(_OTHER).alias("text2"), F.when(m == 0, None).when(m == 3, _ALPHABET.upper()).otherwise(F.col("text")).alias("text3"))
    return consensus.third_pass(rows).select("k", "decision", "sim13", "sim23", F.md5("text_new").alias("digest"))


@query(f"""SELECT conv_id, turn, md5(CASE WHEN conv_id % 7 = 3 OR turn % 4 <> 0 OR regexp_replace(coalesce(text, ''), '{sql.WS}', '', 'g') = '' THEN coalesce(text, '') ELSE '  ' || coalesce(text, '') END) AS digest FROM conversations""")
def q_corrections_table(spark, d):
    """A model's answers on every message: spaced ones are taken, strange and blank ones aren't, some are left out, and some answers aren't JSON."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    new = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("  "), "text")).when(F.col("turn") % 4 == 1, _OTHER).otherwise(" ")
    items = rows.where("turn % 4 <> 3").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(F.col("turn").cast("int").alias("index"), new.alias("text")))).alias("results"))
    answer = F.to_json(F.struct("results"))
    fenced = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("```json\n"), answer, F.lit("\n```"))).otherwise(answer)
    answers = items.select(F.col("conv_id").alias("batch"), F.when(F.col("conv_id") % 7 == 3, F.lit("I can't do that")).otherwise(fenced).alias("content"))
    done = corrections.apply_answers(rows.withColumns({"batch": F.col("conv_id"), "place": F.col("turn")}), answers)
    return done.select("conv_id", "turn", F.md5("corrected").alias("digest"))


@query(f"""WITH q AS (SELECT item_id AS id, CASE item_id % 3 WHEN 0 THEN '' WHEN 1 THEN '问候' ELSE '食物' END AS scene FROM benchmark),
c AS (SELECT CASE role WHEN 'user' THEN 0 ELSE 1 END AS part, conv_id * 100 + turn AS o, {sql.strip("text")} AS text, CASE WHEN conv_id % 40 = 0 THEN '问候' WHEN conv_id % 30 = 1 THEN '食物' ELSE '其他' END AS scene FROM conversations WHERE role IN ('user', 'assistant')),
m AS (SELECT q.id, c.text, 0 AS tier, printf('%d%012d', part, o) AS place FROM q JOIN c ON (q.scene = '' OR q.scene = c.scene) WHERE c.text <> ''),
f AS (SELECT id, text, tier, place FROM (SELECT *, row_number() OVER (PARTITION BY id, text ORDER BY tier, place) AS rn FROM m) WHERE rn = 1),
few AS (SELECT q.id FROM q LEFT JOIN f USING (id) GROUP BY q.id HAVING count(f.text) < 3),
p AS (SELECT few.id, c_name AS text, 3 AS tier, md5('5|' || few.id || '|' || c_name) AS place FROM few, customer WHERE c_name NOT IN (SELECT text FROM f WHERE f.id = few.id))
SELECT id AS query_id, md5(text) AS digest, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tier, place) AS rank FROM (SELECT * FROM f UNION ALL SELECT * FROM p)) WHERE rank <= {retrieval.MAX_EXAMPLES}""")
def q_examples_table(spark, d):
    """Examples for every benchmark item from the conversations, filled up with names where too few match."""
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.expr("CASE item_id % 3 WHEN 0 THEN 'zzz' WHEN 1 THEN '你好' ELSE '好吃' END").alias("text"))
    talk = table(spark, d, "conversations")
    scene = F.array(F.when(F.col("conv_id") % 40 == 0, "问候").when(F.col("conv_id") % 30 == 1, "食物").otherwise("其他"))
    lines = lambda role: talk.where(F.col("role") == role).select((F.col("conv_id") * 100 + F.col("turn")).alias("ordinal"), F.coalesce("text", F.lit("")).alias("text"), F.lit("zh").alias("lang"), scene.alias("scenes"), F.lit(None).cast("string").alias("era_tag"))
    names = table(spark, d, "customer").select(F.col("c_custkey").alias("ordinal"), F.col("c_name").alias("text"), F.lit("zh").alias("lang"), F.array().cast("array<string>").alias("scenes"), F.lit(None).cast("string").alias("era_tag"))
    return retrieval.pick_examples(asked, lines("user"), lines("assistant"), names, 5).select("query_id", F.md5("text").alias("digest"), "rank")


@query("""SELECT c_custkey, list_extract(['日常', '元气', '温柔', '俏皮', '倔强', '惊讶'], (c_custkey % 7 + 1)::INT) AS style, 'a' || c_custkey AS audio, c_name AS prompt_text, CASE WHEN c_custkey % 3 = 0 THEN 'zh' ELSE 'ja' END AS lang,
CASE WHEN c_custkey % 4 = 0 THEN list_extract(['日常', '元气', '温柔', '俏皮', '倔强', '惊讶'], (c_custkey % 7 + 1)::INT) ELSE 'id' || c_custkey END AS clip_id FROM customer WHERE c_custkey % 7 <> 6 AND c_custkey % 5 <> 0""")
def q_style_clips_table(spark, d):
    """A bank of clips per customer; unknown styles and clips without audio go."""
    style = F.expr("element_at(array('日常', '元气', '温柔', '俏皮', '倔强', '惊讶', '别的'), CAST(c_custkey % 7 + 1 AS INT))")
    clip = F.struct(F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit("a"), "c_custkey")).alias("audio"), F.concat(F.lit(" "), "c_name").alias("prompt_text"), F.when(F.col("c_custkey") % 3 != 0, "ja").alias("lang"), F.when(F.col("c_custkey") % 4 != 0, F.concat(F.lit("id"), "c_custkey")).alias("id"))
    banks = table(spark, d, "customer").select("c_custkey", F.create_map(style, F.struct(clip.alias("primary"))).alias("styles"))
    found = readers.style_clips(banks).withColumn("c_custkey", F.regexp_extract("audio", r"(\d+)", 1).cast("long"))
    return found.select("c_custkey", "style", "audio", "prompt_text", "lang", "clip_id")


# --- what the sinks write and the sources read ---------------------------------------------------------------------------


@query("SELECT doc_id, lang, n_chars, md5(coalesce(text, 'none')) AS digest, 'lines' AS form FROM documents UNION ALL SELECT doc_id, lang, n_chars, md5(coalesce(text, 'none')), 'array' FROM documents UNION ALL SELECT doc_id, lang, n_chars, md5(coalesce(text, 'none')), 'items' FROM documents")
def q_json_forms(spark, d):
    """All documents through JSON lines, arrays, and documents of items, each read in splits; each row says by which form it came."""
    ddl = "doc_id long, lang string, n_chars long, text string"
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars", "text")
    lines, arrays, items = (scratch.scratch_path(spark, x) for x in ("lines", "arrays", "items"))
    docs.write.json(lines, ignoreNullFields=False)
    sinks.write_json_arrays(docs, arrays)
    sinks.write_json_arrays(docs, items, '{"version": 2, "note": "}[", "items": [', "]}")
    form = lambda rows, name: rows.select("doc_id", "lang", "n_chars", F.md5(F.coalesce("text", F.lit("none"))).alias("digest"), F.lit(name).alias("form"))
    whole = form(readers.read_json_list(spark, lines, ddl, lines=True), "lines").unionByName(form(readers.read_json_array(spark, arrays, ddl), "array"))
    return whole.unionByName(form(readers.read_json_array(spark, items, ddl, depth=2), "items"))


_KEEP = "doc_id % 3 <> 0"


@query(f"""WITH s AS (SELECT doc_id, CASE WHEN lang = 'ja' THEN 'jp' ELSE lang END AS tag, lang, {_FLAT} AS t, n_chars, doc_id::VARCHAR AS path FROM documents WHERE {_KEEP}),
n AS (SELECT *, printf('%05d_', row_number() OVER (ORDER BY n_chars DESC, path)) || tag || '.wav' AS name FROM s),
tag AS (SELECT *, CASE lang WHEN 'ja' THEN 'JP' WHEN 'zh' THEN 'ZH' WHEN 'en' THEN 'EN' END AS label FROM n)
SELECT 'manifest' AS part, name AS key, md5(path || '|' || t) AS digest FROM n
UNION ALL SELECT 'annotation', name, md5(name || '|h|' || CASE WHEN label IS NULL THEN '' ELSE label || '|' END || replace(t, '|', '/')) FROM tag UNION ALL SELECT 'stats', lang, count(*)::VARCHAR FROM s GROUP BY lang""")
def q_dataset_contents(spark, d):
    """What a dataset's manifest, annotation and statistics hold, row by row."""
    docs = table(spark, d, "documents").where(_KEEP)
    rows = docs.select("lang", F.translate(F.coalesce("text", F.lit("")), "\n\r", "  ").alias("text"), F.col("n_chars").cast("double").alias("score"), F.col("doc_id").cast("string").alias("path"))
    out = scratch.scratch_path(spark, "dataset")
    sinks.write_dataset(rows, out, "h", rows.groupBy("lang").count())
    manifest = spark.read.parquet(f"{out}/manifest").select(F.lit("manifest").alias("part"), F.col("dataset_path").alias("key"), F.md5(F.concat_ws("|", "path", "text")).alias("digest"))
    lines = spark.read.text(f"{out}/annotation").select(F.lit("annotation").alias("part"), F.substring_index("value", "|", 1).alias("key"), F.md5("value").alias("digest"))
    stats = spark.read.schema("lang string, count long").json(f"{out}/stats").select(F.lit("stats").alias("part"), F.col("lang").alias("key"), F.col("count").cast("string").alias("digest"))
    return manifest.unionByName(lines).unionByName(stats)


@query(f"""SELECT 'keep' AS part, doc_id::VARCHAR AS key, 'strict' AS tier, md5(coalesce(text, '')) AS digest FROM documents WHERE {_KEEP} UNION ALL SELECT 'drop', doc_id::VARCHAR, 'drop_' || lang, md5(coalesce(text, '')) FROM documents WHERE NOT ({_KEEP})
UNION ALL SELECT 'report', decision, tier, count(*)::VARCHAR FROM (SELECT CASE WHEN {_KEEP} THEN 'keep' ELSE 'drop' END AS decision, CASE WHEN {_KEEP} THEN 'strict' ELSE 'drop_' || lang END AS tier FROM documents) GROUP BY ALL
UNION ALL SELECT 'pack', doc_id::VARCHAR, lang, md5(translate(text, chr(9) || chr(10) || chr(13), '   ')) FROM documents WHERE text <> ''""")
def q_decisions_contents(spark, d):
    """What the split decisions and the pack for listening hold, row by row."""
    docs = table(spark, d, "documents").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    keep = F.expr(_KEEP)
    out = scratch.scratch_path(spark, "decisions")
    sinks.split_decisions(docs.withColumns({"decision": F.when(keep, "keep").otherwise("drop"), "tier": F.when(keep, "strict").otherwise(F.concat(F.lit("drop_"), "lang"))}), out)
    sinks.listen_pack(docs.where("text <> ''"), f"{out}/pack")
    ddl = "doc_id long, lang string, text string, decision string, tier string"
    row = lambda rows, part, key, tier, digest: rows.select(F.lit(part).alias("part"), F.col(key).cast("string").alias("key"), F.col(tier).alias("tier"), digest.alias("digest"))
    whole = row(spark.read.parquet(f"{out}/manifest"), "keep", "doc_id", "tier", F.md5("text")).unionByName(row(spark.read.schema(ddl).json(f"{out}/dropped"), "drop", "doc_id", "tier", F.md5("text")))
    whole = whole.unionByName(row(spark.read.schema("decision string, tier string, count long").json(f"{out}/report"), "report", "decision", "tier", F.col("count").cast("string")))
    pack = spark.read.csv(f"{out}/pack", sep="\t", header=True, escape="\\", quote='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return whole.unionByName(row(pack, "pack", "doc_id", "lang", F.md5("text")))


@query("""WITH c AS (SELECT lang AS id, count(*) FILTER (WHERE text IS NULL OR text = '') = 0 AS pass, count(*) || ' rows' AS detail FROM documents GROUP BY lang)
SELECT line FROM (SELECT unnest(['# Validation', '', '| check | pass | detail |', '|---|---|---|']) AS line) UNION ALL SELECT '| ' || id || ' | ' || CASE WHEN pass THEN 'yes' ELSE 'no' END || ' | ' || detail || ' |' FROM c
UNION ALL SELECT '' UNION ALL SELECT 'ready: ' || CASE WHEN bool_and(pass) THEN 'yes' ELSE 'no' END FROM c""")
def q_validation_report(spark, d):
    """The lines of a report on checks of the documents by language."""
    checks = table(spark, d, "documents").where("lang is not null").groupBy(F.col("lang").alias("id")).agg((F.count_if(F.coalesce("text", F.lit("")) == "") == 0).alias("pass"), F.concat(F.count(F.lit(1)).cast("string"), F.lit(" rows")).alias("detail"))
    _, report = sinks.validation_report(checks)
    return spark.createDataFrame([(x,) for x in report.split("\n")], "line string")


@query("SELECT l_returnflag, count(l_extendedprice) AS n, " + ", ".join(f"round(quantile_cont(l_extendedprice, {p / 100}), 4) AS p{p:02d}" for p in aggregates.PERCENTS) + " FROM lineitem GROUP BY 1")
def q_selected_percentiles(spark, d):
    """Exact percentiles of prices, nearly all of which differ, by rounds of counting."""
    rows = aggregates.percentiles_by_selection(table(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag"], leaf=1000)
    return rows.select("l_returnflag", "n", *[F.round(f"p{p:02d}", 4).alias(f"p{p:02d}") for p in aggregates.PERCENTS])
