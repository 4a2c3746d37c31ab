"""Queries over literal fixtures and the relational tables, with their SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from winnowry.functions import dates, numeric, similarity
from winnowry.functions import text as T
from winnowry.operators import aggregates, catalog, consensus, gates, joins, retrieval, selection, windows
from winnowry.plans import sql
from winnowry.plans.corpus_queries import table
from winnowry.sources import readers, sinks
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


def values(spark, sql_rows: str):
    return spark.sql(sql_rows)


TEXTS = "SELECT * FROM (VALUES (1, 'こんにちは、今日も配信だよ', 'ja'), (2, '大家好今天也来直播啦', 'zh'), (3, 'やばいやばいやばいやばい', 'ja'), (4, '什么什么什么什么白菜', 'zh'), (5, '啊啊啊啊啊啊啊啊', 'zh'), (6, '알아요. 가요', 'zh'), (7, 'I love youI love you', 'ja'), (8, 'NANANANANANANANANANA', 'zh'), (9, 'ん〜〜〜〜〜〜〜〜〜', 'ja'), (10, 'BGM', 'ja'), (11, '5.20M', 'zh'), (12, '努力!未来!A beautiful star!', 'ja'), (13, '', 'zh'), (14, ' 你 好 ', 'zh'), (15, '1234567890年', 'zh')) AS t(k, text, lang)"


@query(f"WITH {sql.quality(TEXTS)} SELECT k, array_to_string(reasons, ',') AS reasons FROM quality")
def q_text_quality_fixture(spark, d):
    rows = values(spark, TEXTS)
    return rows.select("k", F.array_join(T.quality_reasons(F.col("text"), F.col("lang")), ",").alias("reasons"))


CLIPS = """SELECT k, CAST(duration AS DOUBLE) AS duration, CAST(rms AS DOUBLE) AS rms_db, CAST(v AS DOUBLE) AS voiced_ratio, CAST(cv AS DOUBLE) AS f0_cv, CAST(lv AS DOUBLE) AS longest_voiced, reason FROM (VALUES
(1, 4, -20, 0.3, 0.3, 0.5, NULL), (2, 4, -20, 0.76, 0.14, 0.5, NULL), (3, 4, -20, 0.3, 0.3, 3.01, NULL), (4, 4, -40.01, 0.3, 0.3, 0.5, NULL), (5, 1.49, -20, 0.3, 0.3, 0.5, NULL), (6, 30.01, -20, 0.3, 0.3, 0.5, NULL),
(7, 4, -20, 0.75, 0.14, 0.5, NULL), (8, 4, -20, 0.76, 0.15, 0.5, NULL), (9, 4, -20, 0.3, 0.3, 3.0, NULL), (10, 4, -40.0, 0.3, 0.3, 0.5, NULL), (11, 1.5, -20, 0.3, 0.3, 0.5, NULL), (12, 30.0, -20, 0.3, 0.3, 0.5, NULL),
(13, 4, -20, 0.9, 0.1, 4, NULL), (14, 4, -20, 0.9, NULL, 4, 'singing'), (15, 4, -20, NULL, NULL, NULL, 'singing')) AS t(k, duration, rms, v, cv, lv, reason)"""


@query(f"SELECT k, CASE WHEN duration < 1.5 OR duration > 30 THEN 'duration' WHEN rms_db < -40 THEN 'low_energy' WHEN (voiced_ratio > 0.75 AND f0_cv < 0.15) OR longest_voiced > 3 THEN 'singing' END AS reason FROM ({CLIPS})")
def q_acoustic_gate(spark, d):
    return values(spark, CLIPS).select("k", gates.acoustic_reason().alias("reason"))


@query(f"SELECT k, CASE WHEN voiced_ratio IS NOT NULL AND f0_cv IS NOT NULL AND longest_voiced IS NOT NULL THEN voiced_ratio > 0.75 AND f0_cv < 0.15 AND longest_voiced > 3 ELSE coalesce(reason = 'singing', false) END AS singing FROM ({CLIPS})")
def q_singing_strict(spark, d):
    return values(spark, CLIPS).select("k", gates.is_singing().alias("singing"))


@query("SELECT 1 AS k, 0.75::DOUBLE AS voiced_ratio, 2.0::DOUBLE AS longest_voiced, round(stddev_pop(x) / abs(avg(x)), 9) AS f0_cv FROM (VALUES (100.0::DOUBLE), (150.0), (200.0), (250.0)) AS t(x)")
def q_frame_fold(spark, d):
    rows = values(spark, "SELECT 1 AS k, transform(array(300, 100, NULL, 100, 150, 200, 250, NULL), x -> CAST(x AS DOUBLE)) AS f0, array(true, true, false, true, true, true, true, false) AS voiced, 1024 AS sr, 512 AS hop")
    return aggregates.frame_features(rows).select("k", "voiced_ratio", "longest_voiced", F.round("f0_cv", 9).alias("f0_cv"))


SEGMENTS = "SELECT k, i, text, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, CAST(lp AS DOUBLE) AS lp, CAST(ns AS DOUBLE) AS ns, CAST(cr AS DOUBLE) AS cr FROM (VALUES (1, 1, 'ab', 0, 2, -0.2, 0.1, 1.1), (1, 2, 'cd', 2, 3, -0.5, 0.3, 1.0), (2, 1, 'x', 0, 0, -0.4, NULL, 1.5), (2, 2, 'y', 1, 2, NULL, 0.2, NULL)) AS t(k, i, text, a, b, lp, ns, cr)"


@query(f"SELECT k, string_agg(text, '' ORDER BY i) AS text, round(sum(greatest(b - a, 0.01) * lp) / sum(CASE WHEN lp IS NOT NULL THEN greatest(b - a, 0.01) END), 9) AS avg_logprob, max(ns) AS max_no_speech, max(cr) AS max_compression, count(*) AS n FROM ({SEGMENTS}) GROUP BY k")
def q_segment_rollup(spark, d):
    rows = values(spark, SEGMENTS).groupBy("k").agg(F.sort_array(F.collect_list(F.struct("i", "text", F.col("a").alias("start"), F.col("b").alias("end"), F.col("lp").alias("avg_logprob"), F.col("ns").alias("no_speech_prob"), F.col("cr").alias("compression_ratio")))).alias("segments"))
    r = rows.select("k", aggregates.segment_record(F.col("segments")).alias("r"))
    return r.select("k", "r.text", F.round("r.avg_logprob", 9).alias("avg_logprob"), F.col("r.max_no_speech_probability").alias("max_no_speech"), F.col("r.max_compression_ratio").alias("max_compression"), F.col("r.segment_count").cast("long").alias("n"))


@query("SELECT o_orderstatus AS status, count(*) FILTER (WHERE rn - 1 = n // 2) AS one, max(v) FILTER (WHERE rn - 1 = n // 2) AS mid, max(v) FILTER (WHERE rn - 1 = n // 10) AS low, max(v) FILTER (WHERE rn - 1 = n * 9 // 10) AS high FROM (SELECT 'all' AS o_orderstatus, o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) AS rn, count(*) OVER () AS n FROM orders) GROUP BY 1")
def q_order_statistics(spark, d):
    rows = aggregates.order_statistics(table(spark, d, "orders"), "o_totalprice", {"mid": (1, 2), "low": (1, 10), "high": (9, 10)})
    return rows.select(F.lit("all").alias("status"), F.lit(1).cast("long").alias("one"), "mid", "low", "high")


_RUN = "SELECT o_custkey, o_orderkey, o_totalprice, sum(o_totalprice) OVER w AS running, row_number() OVER w AS rn FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query(f"SELECT o_custkey, o_orderkey, round(running, 2) AS running FROM ({_RUN}) WHERE rn = 1 OR running <= 300000")
def q_running_budget_inclusive(spark, d):
    rows = windows.running_budget(table(spark, d, "orders"), ["o_custkey"], "o_totalprice", 300000.0, F.asc("o_orderdate"), F.asc("o_orderkey"))
    return rows.select("o_custkey", "o_orderkey", F.round("running", 2).alias("running"))


@query(f"SELECT o_custkey, o_orderkey, round(running, 2) AS running FROM ({_RUN}) WHERE running - o_totalprice < 300000")
def q_running_budget_exclusive(spark, d):
    rows = windows.running_budget(table(spark, d, "orders"), ["o_custkey"], "o_totalprice", 300000.0, F.asc("o_orderdate"), F.asc("o_orderkey"), inclusive=False)
    return rows.select("o_custkey", "o_orderkey", F.round("running", 2).alias("running"))


@query("SELECT day, o_orderkey, o_orderpriority FROM (SELECT o_orderdate::DATE AS day, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderdate::DATE ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def q_best_per_day(spark, d):
    rows = table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    return windows.best_per_key(rows, ["day"], F.asc("o_orderpriority"), F.desc("o_totalprice"), F.asc("o_orderkey")).select("day", "o_orderkey", "o_orderpriority")


@query("SELECT l_returnflag, count(l_quantity) AS n, " + ", ".join(f"quantile_cont(l_quantity, {p / 100}) AS p{p:02d}" for p in aggregates.PERCENTS) + " FROM lineitem GROUP BY 1")
def q_percentile_lineitem(spark, d):
    return aggregates.percentiles(table(spark, d, "lineitem"), "l_quantity", ["l_returnflag"])


CATALOG = """SELECT id AS source_id, title, author, CAST(duration AS BIGINT) AS duration, CAST(pubdate AS BIGINT) AS pubdate, CAST(play AS BIGINT) AS play, CAST(o AS BIGINT) AS ordinal FROM (VALUES
('BV1A', '2026-04-22 杂谈 今天怎么样', 'someone', 7200, 1776800000, 1000, 1), ('BV1B', '2026.4.22 聊天', 'SilverCreeper', 3600, 1776800000, 10, 2), ('BV1C', '花音 切片 合集', 'x', 60, 0, 500000, 3), ('BV1C', '花音 切片 合集 长', 'x', 90, 0, 500000, 4),
('BV1D', '3D演唱会', 'x', 9000, 0, 1, 5), ('BV1E', '歌回 全程', 'x', 9000, 0, 1, 6), ('BV1F', '一起看 动画', 'y', 4000, 0, 7, 7), ('BV1G', '随便聊 唱', 'y', 100, 0, 7, 8), ('BV1H', '学中文', NULL, 900, 0, NULL, 9), ('', '杂谈', 'z', 7200, 0, 1, 10), ('BV1Hh9XBnEPF', '杂谈', 'z', 7200, 0, 1, 11)) AS t(id, title, author, duration, pubdate, play, o)"""


def _any(words, x="title") -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


_PLAN = f"""WITH c AS (SELECT source_id, title, coalesce(author, '') AS author, duration, coalesce(play, 0) AS play, ordinal, CASE WHEN {_any(("切片", "经典老番"))} OR (contains(title, '剪辑') AND NOT contains(title, '歌回')) THEN 'A'
    WHEN {_any(catalog.CHAT)} AND NOT {_any(catalog.WATCH)} AND NOT {_any(("歌回", "演唱会"))} THEN 'B' ELSE 'C' END AS tier, CASE WHEN {_any(catalog.HINTS)} THEN 'zh_bias' ELSE 'mixed' END AS lang_hint, {_any(catalog.WATCH)} AS watch, {_any(("歌", "唱"))} AND NOT contains(title, '歌回') AS bgm,
    CASE WHEN regexp_matches(title, '(20\\d{{2}})[-/年.](\\d{{1,2}})[-/月.](\\d{{1,2}})') THEN regexp_extract(title, '(20\\d{{2}})[-/年.](\\d{{1,2}})[-/月.](\\d{{1,2}})', 1) || '-' || lpad(regexp_extract(title, '(20\\d{{2}})[-/年.](\\d{{1,2}})[-/月.](\\d{{1,2}})', 2), 2, '0') || '-' || lpad(regexp_extract(title, '(20\\d{{2}})[-/年.](\\d{{1,2}})[-/月.](\\d{{1,2}})', 3), 2, '0') END AS stream_date
    FROM ({CATALOG}) WHERE source_id <> '' AND source_id NOT IN ({", ".join(f"'{x}'" for x in catalog.EXCLUDED)}) AND NOT contains(title, '3D演唱会') AND NOT (contains(title, '演唱会') AND NOT contains(title, '看')) AND NOT (contains(title, '歌回') AND {_any(("全程", "整场", "全收录"))})),
k AS (SELECT *, CASE WHEN tier = 'A' THEN 'clip:' || source_id ELSE coalesce(stream_date, 'id:' || source_id) END AS key, CASE author {" ".join(f"WHEN '{a}' THEN {v}" for a, v in catalog.UPLOADERS.items())} ELSE 0 END AS pri FROM c WHERE duration >= CASE tier WHEN 'A' THEN 30 WHEN 'B' THEN 600 ELSE 1800 END),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY CASE WHEN tier = 'A' THEN 0 ELSE pri END DESC, duration DESC, ordinal) AS rn FROM k) WHERE rn = 1)
SELECT source_id, tier, lang_hint, array_to_string(list_filter([CASE WHEN watch THEN 'watch' END, CASE WHEN bgm THEN 'bgm' END], lambda x: x IS NOT NULL), ',') AS risk, stream_date,
    round(CASE tier WHEN 'B' THEN 300 WHEN 'A' THEN 200 ELSE 100 END + CASE WHEN lang_hint = 'zh_bias' THEN 10 ELSE 0 END - CASE WHEN watch THEN 20 ELSE 0 END + least(play, 1000000) / 1000000.0 + least(duration, 20000) / 20000.0, 9)::DOUBLE AS priority_score FROM b"""


@query(_PLAN)
def q_catalog_plan(spark, d):
    rows = catalog.build_plan(values(spark, CATALOG))
    return rows.select("source_id", "tier", "lang_hint", F.array_join("risk", ",").alias("risk"), "stream_date", F.round("priority_score", 9).alias("priority_score"))


@query("SELECT * FROM (VALUES (1, '2026-04-22'), (2, '2024-12-01'), (3, '2025-03-09'), (4, '2026-05-06'), (5, NULL), (6, '2026-02-03')) AS t(k, stream_date)")
def q_stream_dates(spark, d):
    rows = values(spark, "SELECT * FROM (VALUES (1, '2026年4月22 杂谈', 0), (2, '录播20241201', 0), (3, '歌 250309', 0), (4, '5月6日 聊天', 1776800000), (5, '无日期 2026-13-45', 0), (6, '2026-13-45 又 260203', 0)) AS t(k, title, pubdate)")
    return rows.select("k", dates.stream_date(F.col("title"), F.col("pubdate")).cast("string").alias("stream_date"))


@query("SELECT * FROM (VALUES (1, 3723::BIGINT), (2, 125::BIGINT), (3, 42::BIGINT), (4, 0::BIGINT)) AS t(k, seconds)")
def q_durations(spark, d):
    rows = values(spark, "SELECT * FROM (VALUES (1, '1:02:03'), (2, '02:05'), (3, '42'), (4, 'live')) AS t(k, s)")
    return rows.select("k", dates.parse_duration(F.col("s")).alias("seconds"))


PAIRS = "SELECT * FROM (VALUES (1, '你好，世界！', '你好世界', NULL), (2, '今天天气很好', '完全不同的话', NULL), (3, '', '', NULL), (4, '只有一个', '', NULL), (5, '今天去公园玩了很开心啊', '今天去公园玩得很开心呀', '今天去公园玩了很开心啊')) AS t(k, primary, secondary, third)"


@query("""SELECT k, decision, tier, final_text, round(sim_ab::DOUBLE, 9) AS sim_ab, sim_ac::DOUBLE AS sim_ac, round(sim_bc::DOUBLE, 9) AS sim_bc, round(cer_ab::DOUBLE, 9) AS cer_ab, chosen FROM (VALUES (1, 'keep', 'strict', '你好，世界！', 1, NULL, NULL, 0, 'primary'),
(2, 'drop', 'drop_low_sim', NULL, 0, NULL, NULL, 1, NULL), (3, 'drop', 'drop_empty', NULL, NULL, NULL, NULL, NULL, NULL), (4, 'drop', 'drop_no_pair', NULL, 0, NULL, NULL, NULL, NULL),
(5, 'drop', 'drop_low_sim', NULL, 18 / 22.0::DOUBLE, 1, 18 / 22.0::DOUBLE, 2 / 11.0::DOUBLE, NULL)) AS t(k, decision, tier, final_text, sim_ab, sim_ac, sim_bc, cer_ab, chosen)""")
def q_similarity_consensus(spark, d):
    rows = values(spark, PAIRS).withColumns({"primary_logprob": F.lit(None).cast("double"), "secondary_logprob": F.lit(None).cast("double")})
    return consensus.adjudicate(rows).select("k", "decision", "tier", "final_text", *[F.round(c, 9).alias(c) for c in ("sim_ab", "sim_ac", "sim_bc", "cer_ab")], "chosen")


@query("SELECT NULL AS lang, 3::BIGINT AS n, 2::BIGINT AS kept, round(2 / 3.0, 9)::DOUBLE AS keep_rate, 0.965::DOUBLE AS mean_sim, 0.93::DOUBLE AS min_sim UNION ALL SELECT 'zh', 2, 1, 0.5, 1.0, 1.0 UNION ALL SELECT 'ja', 1, 1, 1.0, 0.93, 0.93")
def q_consensus_summary(spark, d):
    rows = values(spark, "SELECT lang, decision, CAST(s AS DOUBLE) AS sim_ab FROM (VALUES ('zh', 'keep', 1.0), ('ja', 'keep', 0.93), ('zh', 'drop', 0.4)) AS t(lang, decision, s)")
    return aggregates.decision_summary(rows, ["lang"]).select("lang", "n", "kept", F.round("keep_rate", 9).alias("keep_rate"), F.round("mean_sim", 9).alias("mean_sim"), "min_sim")


FACTS = "SELECT * FROM (VALUES ('f1', 'profile', 'birthday|cake', 'Her birthday is in May.', 1), ('f2', 'profile', 'song', 'She likes songs.', 2), ('f3', 'sensitive', 'boyfriend', 'private', 3), ('f4', 'profile', 'the', 'Common.', 4)) AS t(id, cat, q, fact, ordinal)"


@query(f"""WITH f AS (SELECT id, cat, ordinal, unnest(string_split(q, '|')) AS p FROM ({FACTS})), s AS (SELECT item_id, lower(regexp_replace(text, '{sql.WS}', '', 'g')) AS said FROM benchmark WHERE text IS NOT NULL),
h AS (SELECT item_id, id, cat, ordinal, count(*) AS hits FROM s JOIN f ON contains(said, p) OR contains(p, said) WHERE said <> '' GROUP BY ALL),
g AS (SELECT *, bool_or(cat = 'sensitive') OVER (PARTITION BY item_id) AS sensitive FROM h)
SELECT item_id AS query_id, false AS sensitive, id AS fact_id, hits FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, ordinal) AS rn FROM g WHERE NOT sensitive) WHERE rn <= 4
UNION ALL SELECT DISTINCT item_id, true, NULL, NULL FROM g WHERE sensitive""")
def q_fact_retrieval(spark, d):
    facts = values(spark, FACTS).withColumn("q", F.split("q", r"\|"))
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text").where("text is not null")
    return retrieval.retrieve_facts(queries, facts).select("query_id", "sensitive", "fact_id", "hits")


@query("""WITH q(id, scene, kana) AS (VALUES (1, '问候', false), (2, '', false), (3, '问候', true)), p(text) AS (VALUES ('今天吃什么'), ('再见啦'), ('我们开始吧')),
c(part, o, text, scene, kana) AS (VALUES (0, 1, '你好呀大家', '问候', false), (0, 2, '谢谢你们', '感谢', false), (0, 3, 'こんにちは', '问候', true), (1, 1, '早上好', '问候', false), (1, 2, '好吃', '食物', false)),
m AS (SELECT q.id, c.text, 0 AS tier, printf('%d%012d', part, o) AS place FROM q JOIN c ON (q.scene = '' OR q.scene = c.scene) AND (NOT c.kana OR q.kana)),
f AS (SELECT id, p.text, 3 AS tier, md5('7|' || id || '|' || p.text) AS place FROM (SELECT id FROM m GROUP BY id HAVING count(*) < 3), p)
SELECT id AS query_id, text, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tier, place) AS rank FROM (SELECT * FROM m UNION ALL SELECT * FROM f)) WHERE rank <= 5""")
def q_fewshot_fill(spark, d):
    rows = lambda text: values(spark, f"SELECT ordinal, text, lang, split(scenes, ',') AS scenes, CAST(NULL AS STRING) AS era_tag FROM (VALUES {text}) AS t(ordinal, text, lang, scenes)")
    official = rows("(1, '你好呀大家', 'zh', '问候'), (2, '谢谢你们', 'zh', '感谢'), (3, 'こんにちは', 'ja', '问候')")
    fan = rows("(1, '早上好', 'zh', '问候'), (2, '好吃', 'zh', '食物')")
    pool = rows("(1, '今天吃什么', 'zh', '食物'), (2, '再见啦', 'zh', '告别'), (3, '我们开始吧', 'zh', '游戏')")
    asked = values(spark, "SELECT * FROM (VALUES (1, '你好'), (2, '天气'), (3, 'こんにちは')) AS t(query_id, text)")
    return retrieval.pick_examples(asked, official, fan, pool, 7)


EVENTS = "SELECT * FROM (VALUES ('s', 1, 'sentence', 0, 'Hi. '), ('s', 1, 'sentence', 1, 'Bye.'), ('s', 1, 'audio', 0, NULL), ('s', 1, 'audio_error', 1, NULL), ('s', 1, 'done', NULL, NULL), ('s', 2, 'sentence', 0, 'A'), ('s', 2, 'error', NULL, NULL)) AS t(session_id, turn, type, index, text)"


@query(f"SELECT session_id, turn, coalesce(string_agg(CASE WHEN type = 'sentence' THEN text END, '' ORDER BY index), '') AS text, count(*) FILTER (WHERE type = 'audio') AS n_audio, count(*) FILTER (WHERE type = 'audio_error') AS n_failed, CASE WHEN bool_or(type = 'error') THEN 'error' WHEN bool_or(type = 'done') THEN 'done' ELSE 'open' END AS state FROM ({EVENTS}) GROUP BY ALL")
def q_event_fold(spark, d):
    return session.fold_events(values(spark, EVENTS))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def q_windowed_counts(spark, d):
    return session.windowed_counts(table(spark, d, "events")).withColumn("total", F.round("total", 4))


@query("SELECT DISTINCT user_id, event_type FROM events WHERE json_extract_string(props, '$') IS NOT NULL")
def q_event_json(spark, d):
    rows = table(spark, d, "events")
    return rows.where(F.get_json_object("props", "$").isNotNull()).select("user_id", "event_type").distinct()


@query("SELECT c_nationkey, count(*) AS n, count(DISTINCT c_mktsegment) AS segments, count(*) FILTER (WHERE o_custkey IS NULL) AS without FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders) ON c_custkey = o_custkey GROUP BY 1")
def q_left_join_misses(spark, d):
    has = table(spark, d, "orders").select("o_custkey").distinct()
    rows = table(spark, d, "customer").join(has, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("c_mktsegment").alias("segments"), F.count_if(F.col("o_custkey").isNull()).alias("without"))


@query("SELECT p_partkey AS key FROM part INTERSECT SELECT l_partkey FROM lineitem WHERE l_quantity > 49 EXCEPT SELECT l_partkey FROM lineitem WHERE l_discount > 0.09")
def q_set_operations(spark, d):
    line = table(spark, d, "lineitem")
    both = joins.intersect_keys(table(spark, d, "part").select(F.col("p_partkey").alias("key")), line.where("l_quantity > 49").select(F.col("l_partkey").alias("key")), "key")
    return joins.except_keys(both, line.where("l_discount > 0.09").select(F.col("l_partkey").alias("key")), "key")


LINES = "SELECT ordinal, regexp_replace(value, '~', '|') AS value FROM (VALUES (0, 'a/x.wav|h|JP|text'), (1, 'a/y.wav|h|ZH|one|two'), (2, 'broken|h')) AS t(ordinal, value)"


@query("SELECT * FROM (VALUES (0, 'a/x.wav', 'x.wav', 'ja', 'text'), (1, 'a/y.wav', 'y.wav', 'zh', 'one|two')) AS t(ordinal, path, name, lang, text)")
def q_annotation_parse(spark, d):
    return readers.parse_annotation(values(spark, LINES)).select("ordinal", "path", "name", "lang", "text")


@query(f"SELECT k, CASE WHEN k = 1 THEN 'missing' WHEN k IN (2, 3, 4, 7) THEN 'invalid' WHEN k = 5 THEN 'complete' ELSE 'resumable' END AS state FROM range(1, 8) AS t(k)")
def q_part_state(spark, d):
    rows = values(spark, "SELECT k, present, size, total AS total_size, CAST(e AS DOUBLE) AS expected, CAST(dd AS DOUBLE) AS decoded, clean FROM (VALUES (CAST(1 AS BIGINT), false, 0, 0, 10, 0, true), (2, true, 0, 100, 10, 0, true), (3, true, 101, 100, 10, 10, true), (4, true, 90, 100, 10, 10.3, true), (5, true, 100, 100, 10, 9.9, true), (6, true, 50, 100, 10, 5, true), (7, true, 50, 100, 10, 1, true)) AS t(k, present, size, total, e, dd, clean)")
    return rows.select("k", gates.part_state().alias("state"))


@query("SELECT * FROM (VALUES (1, 'resolved', 'ja'), (2, 'resolved', 'zh'), (3, 'resolved', 'en'), (4, 'resolved', 'auto')) AS t(k, note, lang)")
def q_text_language(spark, d):
    rows = values(spark, "SELECT * FROM (VALUES (1, 'こんにちは世界'), (2, '你好世界'), (3, 'Hello'), (4, '你好 world')) AS t(k, text)")
    return rows.select("k", F.lit("resolved").alias("note"), T.resolve_text_language(F.col("text")).alias("lang"))


@query("SELECT d.doc_id, CASE WHEN d.doc_id % 6 = 2 THEN 'fixed' ELSE lang END AS lang FROM documents d WHERE NOT (d.doc_id % 3 = 1)")
def q_adjudicated_store(spark, d):
    """Deletes and updates of a store by key."""
    store = table(spark, d, "documents").select("doc_id", "lang")
    decisions = store.where("doc_id % 3 = 1 or doc_id % 6 = 2").select("doc_id", F.when(F.col("doc_id") % 3 == 1, "drop").otherwise("keep").alias("decision"), F.when(F.col("doc_id") % 6 == 2, "fixed").alias("text_new"))
    return sinks.apply_adjudication(store, decisions, "doc_id", "lang")


@query(r"SELECT k, CASE WHEN x IN ('nan', 'inf', 'abc') THEN NULL ELSE x::DOUBLE END AS value, least(1, greatest(0, CASE WHEN x IN ('nan', 'inf', 'abc') THEN NULL ELSE x::DOUBLE END)) * CASE WHEN x IN ('nan', 'inf', 'abc') THEN NULL ELSE 1 END AS clamped FROM (VALUES (1, '0.5'), (2, 'nan'), (3, 'inf'), (4, 'abc'), (5, '-3'), (6, '7')) AS t(k, x)")
def q_finite_clamp(spark, d):
    rows = values(spark, "SELECT * FROM (VALUES (1, '0.5'), (2, 'nan'), (3, 'inf'), (4, 'abc'), (5, '-3'), (6, '7')) AS t(k, x)")
    x = numeric.finite(F.col("x"))
    return rows.select("k", x.alias("value"), numeric.clamp(x).alias("clamped"))


@query("SELECT * FROM (VALUES (1, '今天很好呀'), (2, '今天很好'), (3, '今天很好')) AS t(k, text)")
def q_corrections(spark, d):
    rows = values(spark, "SELECT * FROM (VALUES (1, '今天很好', '今天很好呀'), (2, '今天很好', '完全不同'), (3, '今天很好', ' ')) AS t(k, old, new)")
    return rows.select("k", similarity.accept_correction(F.col("old"), F.col("new")).alias("text"))


@query("SELECT doc_id, ((row_number() OVER (PARTITION BY source ORDER BY doc_id)) - 1) // 25 AS batch FROM documents")
def q_batches(spark, d):
    return selection.batches(table(spark, d, "documents").select("doc_id", "source"), 25, ["source"], F.asc("doc_id")).select("doc_id", "batch")
