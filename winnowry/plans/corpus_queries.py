"""Queries over the corpus tables (documents, labels, pages, conversations, embeddings, benchmark) with their SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnowry.config import CompactionLimits
from winnowry.functions import text as T
from winnowry.functions.numeric import l2_normalise
from winnowry.operators import aggregates, joins, scorecard, selection, speaker, validation
from winnowry.plans import sql
from winnowry.streaming import sentences, session

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


DOCS_QUALITY = sql.quality("SELECT doc_id AS k, text, lang FROM documents")


@query(f"WITH {DOCS_QUALITY} SELECT reason, count(*) AS n FROM (SELECT unnest(list_prepend(CASE WHEN len(reasons) = 0 THEN 'keep' ELSE 'drop' END, reasons)) AS reason FROM quality) GROUP BY reason")
def q_text_quality_reasons(spark, d):
    docs = table(spark, d, "documents")
    return aggregates.reason_counts(docs.select(T.quality_reasons(F.col("text"), F.col("lang")).alias("reasons")))


_KEY = f"regexp_replace(coalesce(text, ''), '{sql.PUNCT}', '', 'g')"


@query(f"""WITH p AS (SELECT doc_id, source, n_chars, {_KEY} AS p FROM documents),
c AS (SELECT doc_id, source, n_chars, unnest(CASE WHEN p = '' THEN [''] ELSE string_split(p, '') END) AS c, generate_subscripts(CASE WHEN p = '' THEN [''] ELSE string_split(p, '') END, 1) AS i FROM p),
g AS (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT *, (lag(c) OVER (PARTITION BY doc_id ORDER BY i) IS DISTINCT FROM c)::INT AS s FROM c)),
r AS (SELECT doc_id, source, n_chars, run, first(c) AS c, count(*) AS n FROM g GROUP BY ALL),
k AS (SELECT doc_id, source, n_chars, md5(lower(string_agg(CASE WHEN n >= 3 THEN c ELSE repeat(c, n) END, '' ORDER BY run))) AS key FROM r GROUP BY ALL)
SELECT key, max(doc_id) FILTER (WHERE rn = 1) AS doc_id, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n_chars DESC, doc_id) AS rn FROM k) GROUP BY key""")
def q_content_key_dedupe(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "n_chars", F.md5(T.text_key(F.col("text"))).alias("key"))
    return rows.groupBy("key").agg(F.min_by("doc_id", F.struct(-F.col("n_chars"), F.col("doc_id"))).alias("doc_id"), F.count(F.lit(1)).alias("n"))


@query("SELECT CASE WHEN l.doc_id IS NULL THEN 'alignment_missing' WHEN l.toxic = 1 THEN 'toxic' WHEN l.quality = 0 THEN 'quality' WHEN d.n_chars < 200 THEN 'short_text' ELSE 'keep' END AS reason, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def q_gate_cascade_counts(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels").withColumn("known", F.lit(True)), "doc_id", "left")
    reason = T.first_reason((F.col("known").isNull(), "alignment_missing"), (F.col("toxic") == 1, "toxic"), (F.col("quality") == 0, "quality"), (F.col("n_chars") < 200, "short_text"))
    return aggregates.histogram(rows.select(F.coalesce(reason, F.lit("keep")).alias("reason")))


@query("SELECT source, count(*) AS missing FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY source")
def q_coverage_missing(spark, d):
    return aggregates.histogram(joins.missing_keys(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), "doc_id"), "source", "missing")


def stage_tables(spark, d) -> tuple[DataFrame, ...]:
    """Documents and labels in the parts of the stage tables: deterministic measures from ids and lengths."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    path = F.concat(F.lit("BV"), F.col("doc_id").cast("string"), F.lit("_x.wav"))
    part = lambda m, k: (F.pmod("doc_id", F.lit(m)) / float(k))
    asr = docs.where("doc_id % 10 <> 3").select(path.alias("path"), "lang", "text", (F.col("n_chars") / 307.0).alias("audio_duration"), (0.4 + part(61, 100)).alias("language_probability"), (-part(13, 10)).alias("avg_logprob"), part(7, 10).alias("max_no_speech_probability"), (1.0 + part(17, 10)).alias("max_compression_ratio"))
    filters = docs.where("doc_id % 7 <> 1").select(path.alias("path"), (F.col("n_chars") / 307.0).alias("duration"), (-50.0 + part(41, 1)).alias("rms_db"), part(90, 100).alias("voiced_ratio"), part(30, 100).alias("f0_cv"), part(6, 1).alias("longest_voiced"), F.lit(None).cast("string").alias("reason"))
    speakers = labels.select(path.alias("path"), F.when(F.col("quality") == 1, "accept").otherwise("reject").alias("decision"), part(100, 100).alias("score"), part(50, 100).alias("score_lower"))
    align = docs.where("doc_id % 11 <> 5").select(path.alias("path"), part(97, 97).alias("similarity"), (F.col("doc_id") % 2 == 0).alias("keep"), F.lit(None).cast("string").alias("forced_text"))
    plan = docs.where("doc_id % 3 <> 0").select(F.concat(F.lit("BV"), F.col("doc_id").cast("string")).alias("source_id"), F.when(F.col("doc_id") % 3 == 1, "A").otherwise("B").alias("tier"), F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("watch"))).otherwise(F.array().cast("array<string>")).alias("risk"))
    return filters, speakers, asr, align, plan


CFG = scorecard.ScorecardConfig(languages=("en", "zh", "ja"))
_SCORED = f"""WITH {sql.quality("SELECT doc_id AS k, text, lang FROM documents WHERE doc_id % 10 <> 3")},
m AS (SELECT d.doc_id, CASE WHEN d.doc_id % 10 <> 3 THEN lang ELSE '' END AS lang, CASE WHEN d.doc_id % 10 <> 3 THEN {sql.strip("text")} ELSE '' END AS text, d.doc_id % 10 <> 3 AS a, d.doc_id % 7 <> 1 AS f, l.doc_id IS NOT NULL AS s, d.doc_id % 11 <> 5 AS g,
    CASE WHEN d.doc_id % 7 <> 1 OR d.doc_id % 10 <> 3 THEN n_chars / 307.0::DOUBLE END AS dur, CASE WHEN d.doc_id % 7 <> 1 THEN -50.0::DOUBLE + d.doc_id % 41 END AS rms, (d.doc_id % 90) / 100.0::DOUBLE AS vr, (d.doc_id % 30) / 100.0::DOUBLE AS cv, (d.doc_id % 6)::DOUBLE AS lv,
    l.quality, CASE WHEN l.doc_id IS NOT NULL THEN (d.doc_id % 100) / 100.0::DOUBLE END AS spk, CASE WHEN l.doc_id IS NOT NULL THEN (d.doc_id % 50) / 100.0::DOUBLE END AS low,
    CASE WHEN d.doc_id % 10 <> 3 THEN 0.4::DOUBLE + (d.doc_id % 61) / 100.0::DOUBLE END AS lp, CASE WHEN d.doc_id % 10 <> 3 THEN -((d.doc_id % 13) / 10.0::DOUBLE) END AS lg, (d.doc_id % 7) / 10.0::DOUBLE AS nsp, 1.0::DOUBLE + (d.doc_id % 17) / 10.0::DOUBLE AS cr,
    CASE WHEN d.doc_id % 11 <> 5 THEN (d.doc_id % 97) / 97.0::DOUBLE END AS sim, CASE WHEN d.doc_id % 3 = 1 THEN 'A' WHEN d.doc_id % 3 = 2 THEN 'B' ELSE 'C' END AS tier, d.doc_id % 3 <> 0 AND d.doc_id % 5 = 0 AS watch, q.reasons AS q
    FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN quality q ON q.k = d.doc_id),
n AS (SELECT *, CASE WHEN tier = 'A' THEN 0.5 ELSE 0.45 END AS need, regexp_replace(text, '{sql.WS}', '', 'g') AS ns, regexp_replace(text, '{sql.PUNCT}', '', 'g') AS p FROM m),
cl AS (SELECT doc_id, sum(CASE WHEN c >= 3 THEN 1 ELSE c END) AS cl FROM (SELECT doc_id, g, count(*) AS c FROM (SELECT doc_id, sum(s) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT doc_id, i, (lag(ch) OVER (PARTITION BY doc_id ORDER BY i) IS DISTINCT FROM ch)::INT AS s FROM (SELECT doc_id, unnest(string_split(p, '')) AS ch, generate_subscripts(string_split(p, ''), 1) AS i FROM n WHERE p <> ''))) GROUP BY ALL) GROUP BY doc_id),
r AS (SELECT n.*, coalesce(cl, 0) AS cl, list_filter([CASE WHEN dur IS NULL OR NOT dur BETWEEN 1.5 AND 20 THEN 'duration' END, CASE WHEN rms IS NULL OR rms < -40 THEN 'low_energy' END, CASE WHEN f AND vr > 0.75 AND cv < 0.15 AND lv > 3 THEN 'singing' END,
    CASE WHEN NOT s OR quality <> 1 OR (tier = 'A' AND (low IS NULL OR low < 0.25)) THEN 'speaker' END, CASE WHEN NOT a THEN 'missing_asr' END, CASE WHEN a AND lang NOT IN ('en', 'zh', 'ja') THEN 'lang' END,
    CASE WHEN NOT a OR lp < 0.5 OR lg < -1 OR nsp > 0.6 OR cr > 2.4 THEN 'asr_quality' END, CASE WHEN NOT g THEN 'missing_alignment' END, CASE WHEN NOT g OR sim < need THEN 'alignment' END, CASE WHEN text = '' OR len(q) > 0 THEN 'text_quality' END], lambda x: x IS NOT NULL) AS reject_reasons FROM n LEFT JOIN cl USING (doc_id)),
z AS (SELECT *, least(1, greatest(0, coalesce(sim, 0))) AS c_align, CASE WHEN a THEN 0.5 * least(1, greatest(0, lp)) + 0.5 * least(1, greatest(0, lg + 1)) ELSE 0 END AS c_asr, coalesce(spk, 0) AS c_spk,
    {sql.script_ratio("ns", "CASE WHEN lang = '''' THEN ''zh'' ELSE lang END".replace("''", "'"))} * CASE WHEN cl < 2 THEN 0 WHEN cl <= 40 THEN 1 ELSE greatest(0.5, 40.0::DOUBLE / cl) END AS c_text,
    CASE tier WHEN 'A' THEN 0.8::DOUBLE WHEN 'B' THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END * CASE WHEN watch THEN 0.85::DOUBLE ELSE 1 END AS c_src,
    CASE WHEN dur IS NULL THEN 0 WHEN dur BETWEEN 2 AND 12 THEN 1 WHEN dur >= 1.5 AND dur < 2 THEN 0.5 + 0.5 * (dur - 1.5) / 0.5 WHEN dur > 12 AND dur <= 20 THEN 1 - 0.5 * (dur - 12) / 8 ELSE 0 END AS c_dur FROM r WHERE a OR f OR s OR g)
SELECT doc_id, 'BV' || doc_id || '_x.wav' AS path, 'BV' || doc_id AS source_id, lang, tier, reject_reasons, (30 * c_align + 20 * c_asr + 20 * c_spk + 15 * c_text + 10 * c_src + 5 * c_dur)::DOUBLE AS raw FROM z"""


@query(f"SELECT path, source_id, tier, lang, array_to_string(reject_reasons, ',') AS reject_reasons, CASE WHEN len(reject_reasons) > 0 THEN 'reject' WHEN raw < 60 THEN 'borderline' ELSE 'candidate' END AS decision, round(raw::DECIMAL(18, 9), 4)::DOUBLE AS score FROM ({_SCORED})")
def q_full_outer_scorecard(spark, d):
    rows = scorecard.scorecard(scorecard.union_of_stages(*stage_tables(spark, d)), CFG)
    return rows.select("path", "source_id", "tier", "lang", F.array_join("reject_reasons", ",").alias("reject_reasons"), "decision", F.round("score", 4).alias("score"))


def quota_items(spark, d) -> DataFrame:
    rows = table(spark, d, "documents")
    return rows.select(F.format_string("p%08d", "doc_id").alias("path"), "lang", F.col("source").alias("source_id"), F.lit("candidate").alias("decision"), (F.pmod(F.col("doc_id") * 37, F.lit(101)).cast("double")).alias("score"), F.col("doc_id").cast("string").alias("text"))


@query("""WITH i AS (SELECT printf('p%08d', doc_id) AS path, lang, source AS source_id, ((doc_id * 37) % 101)::DOUBLE AS score,
    CASE WHEN length(doc_id::VARCHAR) >= 3 AND doc_id::VARCHAR = repeat(left(doc_id::VARCHAR, 1), length(doc_id::VARCHAR)) THEN left(doc_id::VARCHAR, 1) ELSE doc_id::VARCHAR END AS text FROM documents),
dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY score DESC, path) AS rn FROM i WHERE score >= 20) WHERE rn = 1 AND lang IN ('en', 'fr')),
z AS (SELECT count(*) FILTER (WHERE lang = 'en') AS p, count(*) FILTER (WHERE lang = 'fr') AS s FROM dd),
e AS (SELECT *, CASE WHEN p = 0 THEN 0 WHEN p < 120 THEN least(200, floor(p / 0.6)::BIGINT) ELSE 200 END AS n_eff FROM z),
q AS (SELECT *, least(s, n_eff - least(p, ceil(0.6 * n_eff)::BIGINT)) AS n_s FROM e), q2 AS (SELECT *, least(p, greatest(least(p, ceil(0.6 * n_eff)::BIGINT), n_eff - n_s)) AS n_p FROM q),
c AS (SELECT dd.*, row_number() OVER (PARTITION BY lang, source_id ORDER BY score DESC, path) AS rs, CASE WHEN lang = 'en' THEN n_p ELSE n_s END AS n, CASE WHEN lang = 'en' THEN greatest(1, floor(0.15 * n_p)) ELSE greatest(1, floor(0.15 * n_s)) END AS cap FROM dd, q2)
SELECT path, lang, source_id, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, path) AS rl FROM c WHERE rs <= cap) WHERE rl <= n""")
def q_quota_select(spark, d):
    return selection.select_quota(quota_items(spark, d), 200, 0.6, 20.0, 0.15, "en", "fr").select("path", "lang", "source_id", "score")


@query("SELECT lang, max(k) AS most, sum(k)::BIGINT AS n, count(*) AS sources, max(k) > greatest(1, floor(0.15 * sum(k))) AS over FROM (SELECT lang, source, count(*) AS k FROM documents GROUP BY ALL) GROUP BY lang")
def q_source_cap_check(spark, d):
    return validation.source_caps(table(spark, d, "documents"), 0.15)


@query("SELECT lang, count(n_chars) AS n, " + ", ".join(f"quantile_cont(n_chars::DOUBLE, {p / 100}) AS p{p:02d}" for p in aggregates.PERCENTS) + " FROM documents GROUP BY lang")
def q_percentile_audit(spark, d):
    return aggregates.percentiles(table(spark, d, "documents"), "n_chars", ["lang"])


@query("SELECT source, count(*) FILTER (WHERE k = 'accept') AS accept, count(*) FILTER (WHERE k = 'uncertain') AS uncertain, count(*) FILTER (WHERE k = 'reject') AS reject, count(*) AS total FROM (SELECT source, CASE WHEN l.doc_id IS NULL THEN 'uncertain' WHEN quality = 1 THEN 'accept' ELSE 'reject' END AS k FROM documents LEFT JOIN labels l USING (doc_id)) GROUP BY source")
def q_decision_crosstab(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    decision = F.when(F.col("quality").isNull(), "uncertain").when(F.col("quality") == 1, "accept").otherwise("reject")
    return aggregates.crosstab(rows.withColumn("k", decision), "source", "k", ["accept", "uncertain", "reject"])


@query("SELECT doc_id, n_chars FROM (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars, doc_id) AS rn, count(*) OVER () AS n FROM documents) WHERE rn <= greatest(1, ceil(0.1 * n))")
def q_bottom_decile(spark, d):
    return selection.bottom_share(table(spark, d, "documents").select("doc_id", "n_chars"), 0.10, F.asc("n_chars"), F.asc("doc_id"))


_LAYERS = (("L1", "lang = 'en' AND doc_id % 3 = 0", 20), ("L2", "doc_id % 4 = 0", 20), ("L3", "n_chars BETWEEN 1000 AND 2000", 16), ("L4", "lang = 'fr'", 12))


def _stratified_sql() -> str:
    parts, taken = [], "SELECT NULL::BIGINT AS doc_id WHERE false"
    for layer, condition, n in _LAYERS:
        parts.append(f"{layer} AS (SELECT '{layer}' AS layer, doc_id FROM documents WHERE {condition} AND doc_id NOT IN ({taken}) ORDER BY md5('7|{layer}|' || doc_id), doc_id LIMIT {n})")
        taken = " UNION ALL ".join(f"SELECT doc_id FROM {x}" for x, _, _ in _LAYERS[: len(parts)])
    return f"WITH {', '.join(parts)} " + " UNION ALL ".join(f"SELECT * FROM {x}" for x, _, _ in _LAYERS)


@query(_stratified_sql())
def q_stratified_sample(spark, d):
    docs = table(spark, d, "documents")
    return selection.stratified([(layer, docs.where(condition), n) for layer, condition, n in _LAYERS], "doc_id", 7)


@query("""WITH k AS (SELECT doc_id, row_number() OVER (ORDER BY md5('11|' || doc_id), doc_id) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL))
SELECT doc_id, CASE WHEN rn <= greatest(1, floor(n * 0.05)) THEN 'dev' ELSE 'train' END AS part FROM documents LEFT JOIN k USING (doc_id)""")
def q_dev_split(spark, d):
    return selection.dev_split(table(spark, d, "documents").select("doc_id"), "doc_id", 0.05, 11)


def vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("label").alias("source"), l2_normalise(F.col("embedding")).alias("vector"))


_UNIT = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / greatest(sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))), 1e-12)) AS u FROM embeddings)"
_CENTRES = """e AS (SELECT label, generate_subscripts(u, 1) AS i, unnest(u) AS x FROM v), m AS (SELECT label, i, avg(x) AS x FROM e GROUP BY ALL),
c AS (SELECT label, list(x ORDER BY i) AS c FROM m GROUP BY label), k AS (SELECT label, list_transform(c, lambda x: x / greatest(sqrt(list_sum(list_transform(c, lambda y: y * y))), 1e-12)) AS c FROM c)"""


@query(f"WITH {_UNIT}, {_CENTRES} SELECT label AS source, (SELECT count(*) FROM v WHERE v.label = k.label) AS n, i AS component, round(x, 6) AS value FROM (SELECT label, generate_subscripts(c, 1) - 1 AS i, unnest(c) AS x FROM k) k")
def q_centroids(spark, d):
    rows = speaker.centroids(vectors(spark, d))
    return rows.select("source", "n", F.posexplode("centroid").alias("component", "value")).select("source", "n", F.col("component").cast("long").alias("component"), F.round("value", 6).alias("value"))


@query(f"WITH {_UNIT}, {_CENTRES} SELECT vec_id AS key, round(quantile_cont(s, 0.5), 6) AS score FROM (SELECT v.vec_id, list_dot_product(v.u, k.c) AS s FROM v JOIN k ON v.label <> k.label) GROUP BY vec_id")
def q_cross_source_median(spark, d):
    v = vectors(spark, d)
    return speaker.median_against_centroids(v, speaker.centroids(v)).select("key", F.round("score", 6).alias("score"))


@query(f"WITH {_UNIT}, p AS (SELECT a.vec_id, o.label, max(list_dot_product(a.u, o.u)) AS s FROM v a JOIN v o ON a.label <> o.label GROUP BY ALL) SELECT vec_id AS key, round(quantile_cont(s, 0.5), 6) AS score FROM p GROUP BY vec_id")
def q_cross_source_max(spark, d):
    return speaker.cross_source_all(vectors(spark, d)).select("key", F.round("score", 6).alias("score"))


def _centroids_sql(rows: str) -> str:
    """(source, c) of rows (source, v)."""
    norm = "list_transform(m, lambda x: x / greatest(sqrt(list_dot_product(m, m)), 1e-12))"
    return f"(SELECT source, {norm} AS c FROM (SELECT source, list(x ORDER BY i) AS m FROM (SELECT source, i, avg(v[i]) AS x FROM {rows}, range(1, 1 + len(v)) AS t(i) GROUP BY 1, 2) GROUP BY 1))"


_DECISION_SQL = f"""WITH raw AS (SELECT vec_id AS key, label AS source, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
v AS (SELECT key, source, list_transform(e, lambda x: x / greatest(sqrt(list_dot_product(e, e)), 1e-12)) AS v FROM raw),
cand AS (SELECT key, source, v FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY key) AS rn FROM v) WHERE rn <= 40),
crossed AS (SELECT key, median(m) AS score FROM (SELECT a.key, b.source, max(list_dot_product(a.v, b.v)) AS m FROM cand a JOIN cand b ON a.source <> b.source GROUP BY 1, 2) GROUP BY 1),
one AS (SELECT key, source, v FROM (SELECT c.*, row_number() OVER (PARTITION BY c.source ORDER BY x.score DESC, c.key) AS rn FROM cand c JOIN crossed x USING (key)) WHERE rn <= 16),
c1 AS {_centroids_sql("one")},
refined AS (SELECT a.key, median(list_dot_product(a.v, c.c)) AS score FROM cand a JOIN c1 c ON a.source <> c.source GROUP BY 1),
chosen AS (SELECT key, source, v FROM (SELECT c.*, row_number() OVER (PARTITION BY c.source ORDER BY x.score DESC, c.key) AS rn FROM cand c JOIN refined x USING (key)) WHERE rn <= 8),
centres AS {_centroids_sql("chosen")},
total AS (SELECT list(x ORDER BY i) AS t FROM (SELECT i, sum(c[i]) AS x FROM centres, range(1, 1 + len(c)) AS t(i) GROUP BY 1)),
rest AS (SELECT source, list_transform(d, lambda x: x / greatest(sqrt(list_dot_product(d, d)), 1e-12)) AS o FROM (SELECT source, list_transform(range(1, 1 + len(c)), lambda i: t[i] - c[i]) AS d FROM centres, total)),
accept AS (SELECT quantile_cont(list_dot_product(v, o), 0.05) - 0.02 AS accept FROM chosen JOIN rest USING (source)),
unused AS (SELECT c.key, c.v, row_number() OVER (ORDER BY x.score, c.key) AS rn, count(*) OVER () AS n FROM cand c JOIN crossed x USING (key) WHERE c.key NOT IN (SELECT key FROM chosen)),
g AS (SELECT list_transform(t, lambda x: x / greatest(sqrt(list_dot_product(t, t)), 1e-12)) AS g FROM total),
reject AS (SELECT coalesce(quantile_cont(list_dot_product(v, g), 0.99), -1) AS reject FROM unused, g WHERE rn <= greatest(8, n // 5)),
placed AS (SELECT c, row_number() OVER (ORDER BY source) - 1 AS place, count(*) OVER () AS n FROM centres),
draws AS (SELECT r, ('0x' || substr(md5(concat_ws('|', {speaker.SEED}, r, j)), 1, 8))::BIGINT % (SELECT max(n) FROM placed) AS place FROM range({speaker.RESAMPLES}) AS a(r), (SELECT unnest(range((SELECT max(n) FROM placed))) AS j)),
mean AS (SELECT r, list_transform(m, lambda x: x / greatest(sqrt(list_dot_product(m, m)), 1e-12)) AS m FROM (SELECT r, list(x ORDER BY i) AS m FROM (SELECT r, i, avg(c[i]) AS x FROM draws JOIN placed USING (place), range(1, 1 + len(c)) AS t(i) GROUP BY 1, 2) GROUP BY 1)),
b AS (SELECT key, quantile_cont(list_dot_product(v, m), 0.05) AS score_lower, quantile_cont(list_dot_product(v, m), 0.95) AS score_upper FROM v, mean GROUP BY 1),
s AS (SELECT key, median(list_dot_product(v, c)) AS score FROM v, centres GROUP BY 1)
SELECT key, CASE WHEN score_lower >= accept THEN 'accept' WHEN reject + 0.03 < accept AND score_upper <= reject THEN 'reject' ELSE 'uncertain' END AS decision, round(score, 6) AS score, round(score_lower, 6) AS score_lower, round(score_upper, 6) AS score_upper
FROM b JOIN s USING (key), accept, reject"""


@query(_DECISION_SQL)
def q_speaker_decision(spark, d):
    v = vectors(spark, d)
    bounded = speaker.candidates(v.withColumn("start", F.col("key")), 40).drop("start")
    centres, limits = speaker.calibrate(bounded)
    return speaker.decide(v, centres, limits).select("key", "decision", F.round("score", 6).alias("score"), F.round("score_lower", 6).alias("score_lower"), F.round("score_upper", 6).alias("score_upper"))


@query(r"SELECT page_id, length(regexp_replace(html, '<[^>]+>', '', 'g')) AS n_text, md5(regexp_replace(html, '<[^>]+>', '', 'g')) AS digest FROM pages")
def q_html_strip(spark, d):
    plain = T.strip_tags(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.length(plain).cast("long").alias("n_text"), F.md5(plain).alias("digest"))


@query()
def q_speech_clean(spark, d):
    from winnowry.functions.speech import normalize_speech_text

    rows = table(spark, d, "conversations").select("conv_id", "turn", normalize_speech_text(F.col("text")).alias("speech"))
    return rows.select("conv_id", "turn", "speech", T.resolve_text_language(F.col("speech")).alias("language"))


@query()
def q_sentence_split(spark, d):
    rows = table(spark, d, "conversations").where("role = 'assistant'").withColumnRenamed("conv_id", "session_id")
    return sentences.split_texts(rows, F.col("text"))


def messages(spark, d) -> DataFrame:
    return table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "role", F.coalesce("text", F.lit("")).alias("content"))


@query("""WITH t AS (SELECT conv_id AS session_id, turn, role, coalesce(text, '') AS content FROM conversations WHERE role IN ('user', 'assistant')),
e AS (SELECT session_id, count(*) AS n, sum(length(content)) AS chars, arg_max(role, turn) AS last FROM t GROUP BY session_id),
u AS (SELECT *, (n - (last = 'user')::INT) // 2 AS turns FROM e)
SELECT session_id, ((turns - 1) * 2)::BIGINT AS archived FROM u WHERE (turns >= 2 OR chars >= 4000) AND turns > 1""")
def q_history_compaction(spark, d):
    return session.plan_compaction(messages(spark, d), CompactionLimits(2, 4000, 1, 1800)).select("session_id", F.col("archived").cast("long").alias("archived"))


@query("""WITH t AS (SELECT conv_id AS session_id, turn, role, coalesce(text, '') AS content FROM conversations)
SELECT session_id, count(*) AS n, max(turn) AS last_turn FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS rn FROM t) WHERE NOT (rn = 1 AND role = 'user') GROUP BY session_id""")
def q_committed_turns(spark, d):
    return session.committed(messages(spark, d)).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.max("turn").alias("last_turn"))


@query("SELECT conv_id AS session_id, string_agg(CASE WHEN role = 'assistant' THEN coalesce(text, '') END, '' ORDER BY turn) IS NOT NULL AS talks, md5(coalesce(string_agg(CASE WHEN role = 'system' THEN coalesce(text, '') END, chr(10) || chr(10) ORDER BY turn), '')) AS system_md5, md5(coalesce(string_agg(CASE WHEN role IN ('user', 'assistant') THEN role || ': ' || coalesce(text, '') END, chr(10) ORDER BY turn), '')) AS dialogue_md5 FROM conversations GROUP BY conv_id")
def q_summary_prompt(spark, d):
    rows = session.summary_prompt(messages(spark, d))
    return rows.select("session_id", F.col("dialogue").contains("assistant: ").alias("talks"), F.md5("system").alias("system_md5"), F.md5("dialogue").alias("dialogue_md5"))


@query("""WITH k AS (SELECT doc_id, lang, source, CASE WHEN doc_id % 3 = 0 THEN 'peak' WHEN doc_id % 3 = 1 THEN 'late' ELSE 'unknown' END AS era_tag, n_chars AS key FROM documents),
b AS (SELECT *, CASE era_tag WHEN 'peak' THEN 0 ELSE 1 END AS o1, CASE era_tag WHEN 'peak' THEN 0 WHEN 'unknown' THEN 1 ELSE 2 END AS o2, (lang <> 'zh')::INT AS o3 FROM k),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY o1, o2, o3, doc_id) AS rn FROM b) WHERE rn = 1)
SELECT printf('Q%04d', r) AS id, doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY o1, o2, o3, doc_id) AS r FROM f) WHERE r <= 180""")
def q_review_queue(spark, d):
    era = F.when(F.col("doc_id") % 3 == 0, "peak").when(F.col("doc_id") % 3 == 1, "late").otherwise("unknown")
    rows = table(spark, d, "documents").select("doc_id", "lang", era.alias("era_tag"), F.col("doc_id").alias("ordinal"), F.col("n_chars").alias("key"))
    return selection.review_queue(rows).select("id", "doc_id")


@query("SELECT lang, source, count(*) AS n, round(avg(n_chars), 6) AS mean_chars FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")
def q_grouping_sets(spark, d):
    rows = table(spark, d, "documents")
    return rows.groupingSets([[F.col("lang")], [F.col("source")], []], "lang", "source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 6).alias("mean_chars"))


@query("SELECT d.doc_id, d.lang, l.quality FROM documents d JOIN labels l USING (doc_id) WHERE d.doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def q_semi_join_whitelist(spark, d):
    labels = table(spark, d, "labels")
    rows = joins.whitelisted(table(spark, d, "documents").select("doc_id", "lang"), labels.where("toxic = 1"), "doc_id")
    return rows.join(labels.select("doc_id", "quality"), "doc_id")


@query("SELECT doc_id, lang, coalesce(quality, -1) AS quality FROM (SELECT doc_id, lang FROM documents) LEFT JOIN labels USING (doc_id) WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id, 'xx', 9 FROM labels WHERE doc_id % 5 <> 0")
def q_incremental_upsert(spark, d):
    """A cache of labelled rows upserted by a new batch: new rows replace, pending ones are added."""
    from winnowry.sources.sinks import upsert

    docs, labels = table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels").select("doc_id", "quality")
    cache = labels.select("doc_id", F.lit("xx").alias("lang"), F.lit(9).alias("quality"))
    new = docs.where("doc_id % 5 = 0").join(labels, "doc_id", "left").select("doc_id", "lang", F.coalesce("quality", F.lit(-1)).alias("quality"))
    return upsert(cache, new, "doc_id")
