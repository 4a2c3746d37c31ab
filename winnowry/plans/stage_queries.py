"""Queries that run the gates, joins, checks and audits over stage tables made of the corpus tables, with their SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnowry.config import ScorecardConfig, ValidationLimits
from winnowry.functions import text as T
from winnowry.operators import aggregates, catalog, gates, joins, retrieval, selection, validation, windows
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


#: Columns of stage tables as expressions that Spark and the other engine read alike: name -> (Spark, SQL).
MEASURES = {
    "path": "concat('BV', doc_id, '_x.wav')",
    "audio_duration": "CAST(n_chars / 10.0 + doc_id % 5 AS DOUBLE)",
    "language_probability": "CAST((doc_id % 20) / 20.0 AS DOUBLE)",
    "avg_logprob": "CASE WHEN doc_id % 23 = 0 THEN NULL ELSE CAST(-((doc_id % 13) / 10.0) AS DOUBLE) END",
    "max_no_speech_probability": "CAST((doc_id % 8) / 10.0 AS DOUBLE)",
    "max_compression_ratio": "CAST(1 + (doc_id % 17) / 10.0 AS DOUBLE)",
    "similarity": "CASE WHEN doc_id % 9 = 0 THEN NULL ELSE CAST((doc_id % 40) / 40.0 AS DOUBLE) END",
}


def staged(spark, d) -> DataFrame:
    """Documents with measures of stage tables and their labels."""
    docs = table(spark, d, "documents").selectExpr("doc_id", "text", "lang", "source", "n_chars", *[f"{e} AS {n}" for n, e in MEASURES.items()])
    return docs.join(table(spark, d, "labels"), "doc_id", "left")


STAGED = "SELECT d.doc_id, text, lang, source, n_chars, quality, toxic, " + ", ".join(f"{e.replace('doc_id', 'd.doc_id')} AS {n}" for n, e in MEASURES.items()) + " FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"
_QUALITY = sql.quality("SELECT doc_id AS k, text, lang FROM documents")
_NS = f"length(regexp_replace(coalesce(text, ''), '{sql.WS}', '', 'g'))"


@query(f"""WITH {_QUALITY}, s AS ({STAGED}) SELECT doc_id, CASE
    WHEN doc_id % 31 = 0 THEN 'source_whitelist' WHEN doc_id % 7 = 1 THEN 'audio_filter' WHEN quality IS NULL THEN 'speaker_missing' WHEN quality = 0 THEN 'speaker_reject' WHEN lang NOT IN ('ja', 'zh', 'en') THEN 'language'
    WHEN length({sql.strip("text")}) < 2 THEN 'short_text' WHEN len(q.reasons) > 0 THEN 'text_' || q.reasons[1] WHEN doc_id % 11 = 5 THEN 'alignment_missing' WHEN doc_id % 2 = 1 AND doc_id % 4 = 1 THEN 'alignment_' || CASE WHEN doc_id % 8 = 1 THEN 'drift' ELSE 'rejected' END
    WHEN similarity < 0.45 THEN 'alignment_low_sim' WHEN audio_duration > 0 AND {_NS} / audio_duration > 12 THEN 'text_density' WHEN audio_duration > 0 AND language_probability < 0.5 THEN 'language_confidence'
    WHEN audio_duration > 0 AND (avg_logprob IS NULL OR avg_logprob < -1) THEN 'asr_logprob' WHEN audio_duration > 0 AND max_no_speech_probability > 0.6 THEN 'asr_no_speech' WHEN audio_duration > 0 AND max_compression_ratio > 2.4 THEN 'asr_compression'
    WHEN doc_id % 37 = 2 THEN 'missing_audio' WHEN n_chars * 4 < 8000 THEN 'tiny_audio' END AS reason FROM s JOIN quality q ON q.k = s.doc_id""")
def q_gate_cascade(spark, d):
    rows = staged(spark, d).withColumns({
        "whitelisted": F.expr("doc_id % 31 <> 0"), "filter_keep": F.expr("CASE WHEN doc_id % 7 = 1 THEN NULL ELSE true END"), "decision": F.expr("CASE quality WHEN 1 THEN 'accept' WHEN 0 THEN 'reject' END"),
        "align_keep": F.expr("NOT (doc_id % 2 = 1 AND doc_id % 4 = 1)"), "align_reason": F.expr("CASE WHEN doc_id % 8 = 1 THEN 'drift' END"), "forced_text": F.lit(None).cast("string"), "aligned": F.expr("doc_id % 11 <> 5"),
        "asr_quality_version": F.lit(1), "file_size": F.expr("CASE WHEN doc_id % 37 <> 2 THEN n_chars * 4 END"),
    })
    return gates.cascade(rows).select("doc_id", "reason")


@query(f"WITH {_QUALITY} SELECT CASE WHEN l.doc_id IS NULL THEN 'speaker_missing' WHEN quality = 0 THEN 'speaker_reject' WHEN len(reasons) > 0 THEN 'text' ELSE 'keep' END AS reason, count(*) AS n FROM quality q LEFT JOIN labels l ON l.doc_id = q.k GROUP BY 1")
def q_alignment_candidates(spark, d):
    """Rows worth a second transcription, counted, and why the others aren't."""
    rows = staged(spark, d).withColumns({"filter_keep": F.lit(True), "decision": F.expr("CASE quality WHEN 1 THEN 'accept' WHEN 0 THEN 'reject' END")})
    worth = gates.candidates_for_alignment(rows).select("doc_id", F.lit(True).alias("keep"))
    reason = F.when(F.col("keep"), "keep").when(F.col("decision").isNull(), "speaker_missing").when(F.col("decision") == "reject", "speaker_reject").otherwise("text")
    return aggregates.histogram(rows.join(worth, "doc_id", "left").select(reason.alias("reason")))


@query(f"""WITH {_QUALITY}, s AS ({STAGED}) SELECT doc_id, CASE WHEN length({sql.strip("text")}) = 0 THEN 'empty_forced' WHEN len(q.reasons) > 0 THEN 'forced_text_' || q.reasons[1]
    WHEN similarity < 0.45 THEN 'low_similarity' WHEN avg_logprob < -1 THEN 'forced_logprob' WHEN max_no_speech_probability > 0.6 THEN 'forced_no_speech' END AS reason FROM s JOIN quality q ON q.k = s.doc_id""")
def q_alignment_verdict(spark, d):
    return staged(spark, d).withColumnRenamed("text", "forced_text").select("doc_id", gates.alignment_verdict().alias("reason"))


@query(f"""WITH {_QUALITY}, s AS ({STAGED}) SELECT doc_id FROM s JOIN quality q ON q.k = s.doc_id WHERE (doc_id % 3 = 0 OR doc_id % 3 = 1) AND doc_id % 5 IN (1, 2) AND doc_id % 4 >= 1 AND doc_id % 7 <= 3 AND doc_id % 9 <= 2 AND len(q.reasons) = 0""")
def q_confidence_pool(spark, d):
    """A log probability of 0 counts as missing."""
    rows = staged(spark, d).withColumns({"segment_count": F.expr("CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 1 ELSE 2 END"), "avg_logprob": F.expr("CAST(-((doc_id % 5) / 10.0) AS DOUBLE)"), "language_probability": F.expr("CAST(0.85 + (doc_id % 4) / 20.0 AS DOUBLE)"),
                                         "max_no_speech_probability": F.expr("CAST((doc_id % 7) / 10.0 AS DOUBLE)"), "max_compression_ratio": F.expr("CAST(1 + (doc_id % 9) / 10.0 AS DOUBLE)")})
    return rows.where(gates.meets_confidence()).select("doc_id")


@query("""WITH f AS (SELECT doc_id, doc_id % 4 <> 1 AS keep FROM documents), s AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'accept' WHEN 1 THEN 'uncertain' ELSE 'reject' END AS decision FROM documents)
SELECT 'both' AS policy, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM f JOIN s USING (doc_id) WHERE keep AND decision <> 'reject' UNION ALL SELECT 'accept', count(*), sum(doc_id)::BIGINT FROM f JOIN s USING (doc_id) WHERE keep AND decision = 'accept'""")
def q_select_slices(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"))
    filters = docs.select("path", F.expr("doc_id % 4 <> 1").alias("keep"))
    speakers = docs.select("path", F.expr("CASE doc_id % 3 WHEN 0 THEN 'accept' WHEN 1 THEN 'uncertain' ELSE 'reject' END").alias("decision"))
    parts = [gates.select_slices(docs, filters, speakers, p).agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids")).select(F.lit(name).alias("policy"), "n", "ids") for p, name in (("accept-or-uncertain", "both"), ("accept", "accept"))]
    return parts[0].unionByName(parts[1])


@query("""SELECT doc_id, 's' || doc_id % 50 AS stem, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id * 320 / 32000.0::DOUBLE END AS start, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE (doc_id * 320 + 64000) / 32000.0::DOUBLE END AS stop FROM documents WHERE doc_id % 50 IN (SELECT doc_id FROM labels WHERE toxic = 0 AND doc_id < 50)""")
def q_slice_names(spark, d):
    """Slices of whitelisted recordings, with what their names say."""
    name = F.concat(F.lit("s"), F.col("doc_id") % 50, F.lit("_(Vocals)"), F.when(F.col("doc_id") % 5 == 0, ".wav").otherwise(F.format_string("__%010d_%010d.wav", F.col("doc_id") * 320, F.col("doc_id") * 320 + 64000)))
    files = table(spark, d, "documents").select("doc_id", F.concat(F.lit("/a/b/"), name).alias("path"))
    stems = table(spark, d, "labels").where("toxic = 0 AND doc_id < 50").select(F.concat(F.lit("s"), "doc_id").alias("stem"))
    rows = gates.is_derivative(files, stems).withColumn("at", T.slice_offsets(F.col("path")))
    return rows.select("doc_id", "stem", F.col("at.start").alias("start"), F.col("at.end").alias("stop"))


_PHONES = "CASE doc_id % 4 WHEN 0 THEN 0 ELSE doc_id % 70 END"


@query(f"""WITH {sql.quality("SELECT doc_id AS k, text, 'zh' AS lang FROM documents")}, s AS ({STAGED}) SELECT doc_id, array_to_string(list_concat(list_transform(q.reasons, lambda r: 'text:' || r), list_filter([
    CASE WHEN ({_PHONES}) BETWEEN 1 AND 11 THEN 'phoneme_lt12' END, CASE WHEN ({_PHONES}) > 60 THEN 'phoneme_gt60' END, CASE WHEN NOT coalesce(n_chars / 100.0, 0) BETWEEN 2.5 AND 10 THEN 'duration_out_of_range' END,
    CASE WHEN coalesce(avg_logprob, 0) > -0.45 THEN 'logprob_gt0.45' END, CASE WHEN coalesce(language_probability, 0) < 0.7 THEN 'lang_prob_low' END, CASE WHEN coalesce((doc_id % 10) / 10.0, 0) < 0.5 THEN 'asr_comp_low' END,
    CASE WHEN length({sql.strip("text")}) < 8 AND NOT regexp_matches({sql.strip("text")}, '[。！？…!?.;；]$') THEN 'truncated_short' END], lambda x: x IS NOT NULL)), ',') AS reasons FROM s JOIN quality q ON q.k = s.doc_id""")
def q_clip_reasons(spark, d):
    rows = staged(spark, d).withColumns({"phones": F.expr(f"trim(repeat('a ', {_PHONES}))"), "duration": F.expr("CAST(n_chars / 100.0 AS DOUBLE)"), "comp_asr": F.expr("CAST((doc_id % 10) / 10.0 AS DOUBLE)")})
    return rows.select("doc_id", F.array_join(gates.clip_reasons("zh"), ",").alias("reasons"))


@query("""WITH r AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS tier, doc_id % 2 = 0 AS a, doc_id % 5 = 0 AS b FROM documents)
SELECT 'rows' AS kind, 'total' AS name, count(*) AS n FROM r UNION ALL SELECT 'rows', 'keep', count(*) FILTER (WHERE NOT a AND NOT b) FROM r UNION ALL SELECT 'rows', 'drop', count(*) FILTER (WHERE a OR b) FROM r
UNION ALL SELECT 'tier', tier, count(*) FROM r WHERE NOT a AND NOT b GROUP BY tier UNION ALL SELECT 'reason', 'a', count(*) FROM r WHERE a UNION ALL SELECT 'reason', 'b', count(*) FROM r WHERE b""")
def q_clip_summary(spark, d):
    rows = table(spark, d, "documents").select(F.expr("CASE doc_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END").alias("tier"), T.reasons((F.col("doc_id") % 2 == 0, "a"), (F.col("doc_id") % 5 == 0, "b")).alias("reasons"))
    return aggregates.clip_summary(rows)


@query("SELECT d.doc_id FROM documents d JOIN labels USING (doc_id) WHERE (d.doc_id % 40) / 40.0 >= 0.6 AND (d.doc_id % 40) / 40.0 < 0.85")
def q_mid_band(spark, d):
    report = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("name"), F.expr("CAST((doc_id % 40) / 40.0 AS DOUBLE)").alias("similarity"))
    return gates.mid_band(report, table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("name"))).select("doc_id")


@query("""WITH c AS (SELECT doc_id, doc_id % 5 <> 0 AS raw, doc_id % 7 <> 0 AS wav, doc_id % 11 = 0 AS bad, CASE doc_id % 13 WHEN 0 THEN NULL ELSE 100.0 END AS e, 90.0 + doc_id % 12 AS r, 90.0 + doc_id % 9 AS w FROM documents)
SELECT doc_id, CASE WHEN NOT raw THEN 'missing_raw' WHEN NOT wav THEN 'missing_wav' WHEN bad THEN 'probe_error' WHEN coalesce(e, 0) <= 0 THEN 'unchecked' WHEN r < 0.98 * e THEN 'truncated_raw' WHEN abs(w - r) > 0.02 * r THEN 'wav_mismatch' ELSE 'ready' END AS status FROM c""")
def q_asset_audit(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("BV"), "doc_id").alias("source_id"))
    file = lambda keep, end: docs.where(keep).select(F.concat(F.lit("/x/"), "source_id", F.lit(f"_p1{end}")).alias("path"))
    rows = joins.assets(docs, file("doc_id % 5 <> 0", ".m4a"), file("doc_id % 7 <> 0", ".wav"))
    rows = rows.withColumns({"probe_error": F.expr("doc_id % 11 = 0"), "expected": F.expr("CASE doc_id % 13 WHEN 0 THEN NULL ELSE 100.0D END"), "raw_duration": F.expr("90.0D + doc_id % 12"), "wav_duration": F.expr("90.0D + doc_id % 9")})
    return rows.select("doc_id", gates.asset_status().alias("status"))


@query("SELECT o_orderkey AS stem FROM orders LEFT JOIN (SELECT l_orderkey, max(l_extendedprice) AS m FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE coalesce(m, 0) < 0.3 * o_totalprice")
def q_incomplete_outputs(spark, d):
    sources = table(spark, d, "orders").select(F.col("o_orderkey").alias("stem"), F.col("o_totalprice").alias("duration"))
    return gates.incomplete_outputs(sources, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("stem"), F.col("l_extendedprice").alias("duration")), 0.3).select("stem")


@query(f"""SELECT conv_id, turn, CASE WHEN {sql.strip("text")} = '' THEN 'empty_text' WHEN length({sql.strip("text")}) > 2000 THEN 'text_too_long' WHEN conv_id % 6 = 0 THEN 'bad_session' END AS error FROM conversations""")
def q_valid_requests(spark, d):
    rows = table(spark, d, "conversations").withColumn("session_id", F.when(F.col("conv_id") % 6 == 0, F.lit("no good!")).otherwise(F.concat(F.lit("s-"), "conv_id")))
    return gates.valid_requests(rows).select("conv_id", "turn", "error")


_JOINED = "SELECT d.doc_id, CASE WHEN d.doc_id % 2 = 0 THEN d.doc_id % 4 = 0 END AS filter_keep, CASE quality WHEN 1 THEN 'accept' WHEN 0 THEN 'reject' END AS decision, d.doc_id % 3 = 0 AS aligned, CASE WHEN d.doc_id % 3 = 0 THEN (d.doc_id % 50) / 50.0::DOUBLE END AS similarity, CASE WHEN d.doc_id % 3 = 0 THEN 'f' || d.doc_id END AS forced_text FROM documents d LEFT JOIN labels USING (doc_id)"


@query(_JOINED)
def q_join_stages(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"))
    filters = docs.where("doc_id % 2 = 0").select("path", F.expr("doc_id % 4 = 0").alias("keep"))
    speakers = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("path"), F.expr("CASE quality WHEN 1 THEN 'accept' WHEN 0 THEN 'reject' END").alias("decision"))
    align = docs.where("doc_id % 3 = 0").select("path", F.lit(True).alias("keep"), F.lit(None).cast("string").alias("reason"), F.expr("CAST((doc_id % 50) / 50.0 AS DOUBLE)").alias("similarity"), F.concat(F.lit("f"), "doc_id").alias("forced_text"))
    return joins.join_stages(docs, filters, speakers, align).select("doc_id", "filter_keep", "decision", "aligned", "similarity", "forced_text")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'new' || doc_id END AS text_1, CASE WHEN doc_id % 2 = 0 THEN -0.25::DOUBLE END AS logprob_1, doc_id % 2 = 0 AS has_1, CASE WHEN doc_id % 5 = 0 THEN 'b' || doc_id END AS text_2, doc_id % 5 = 0 AS has_2 FROM documents")
def q_engines(spark, d):
    """Annotation rows with two engines' transcripts, the last of equal names."""
    docs = table(spark, d, "documents").select("doc_id", F.concat("doc_id", F.lit(".wav")).alias("name"))
    one = docs.where("doc_id % 2 = 0").select(F.lit(None).cast("string").alias("name"), F.concat(F.lit("/p/"), "name").alias("path"), F.concat(F.lit("old"), "doc_id").alias("text"), F.lit(-0.5).alias("avg_logprob"), F.lit(0).alias("ordinal"))
    one = one.unionByName(docs.where("doc_id % 2 = 0").select("name", F.lit("").alias("path"), F.concat(F.lit("new"), "doc_id").alias("text"), F.lit(-0.25).alias("avg_logprob"), F.lit(1).alias("ordinal")))
    two = docs.where("doc_id % 5 = 0").select("name", F.lit("").alias("path"), F.concat(F.lit("b"), "doc_id").alias("text"), F.lit(-0.1).alias("avg_logprob"), F.lit(0).alias("ordinal"))
    return joins.engines(docs, one, two).select("doc_id", "text_1", "logprob_1", "has_1", "text_2", "has_2")


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'no_pass1' END AS note, CASE WHEN l.doc_id IS NOT NULL THEN 'q' || quality END AS text_first FROM documents d LEFT JOIN labels l USING (doc_id)")
def q_crosscheck(spark, d):
    second = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("name"), "text")
    return joins.crosscheck(second, table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("name"), F.concat(F.lit("q"), "quality").alias("text"))).select("doc_id", "note", "text_first")


@query("SELECT d.doc_id, d.source, 'r' || quality AS reasons, CASE WHEN d.doc_id % 3 = 0 THEN 'p' || d.doc_id END AS phones FROM documents d JOIN labels USING (doc_id)")
def q_rehydrate(spark, d):
    """Curated keys back to the manifest's rows, with their phonemes."""
    docs = table(spark, d, "documents").select("doc_id", "source", F.concat(F.lit("/out/"), "doc_id").alias("dataset_path"))
    curated = table(spark, d, "labels").select(F.concat(F.lit("/out/"), "doc_id").alias("dataset_path"), F.concat(F.lit("r"), "quality").alias("reasons"))
    features = docs.where("doc_id % 3 = 0").select(F.col("doc_id").cast("string").alias("name"), F.concat(F.lit("p"), "doc_id").alias("phones"))
    return joins.with_phonemes(joins.rehydrate(curated, docs), features).select("doc_id", "source", "reasons", "phones")


@query("SELECT a.conv_id, a.turn, length(a.text) - length(b.text) AS gain FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn WHERE a.turn > 0")
def q_compare_versions(spark, d):
    rows = table(spark, d, "conversations")
    side = lambda r: r.select(F.concat_ws("-", "conv_id", "turn").alias("name"), "text", F.lit(-0.1).alias("avg_logprob"))
    met = joins.compare_versions(side(rows), side(rows.where("turn > 0")))
    part = lambda k: F.split("name", "-")[k].cast("long")
    return met.select(part(0).alias("conv_id"), part(1).alias("turn"), (F.length("new_text") - F.length("old_text")).cast("long").alias("gain"))


@query("""WITH t AS (SELECT doc_id AS k, 1 AS part, 'd' AS v FROM documents UNION ALL SELECT doc_id, 2, 'l' || quality FROM labels UNION ALL SELECT item_id, 3, 'b' FROM benchmark) SELECT k, arg_max(v, part) AS v FROM t GROUP BY k""")
def q_union_last_wins(spark, d):
    docs, labels, bench = table(spark, d, "documents"), table(spark, d, "labels"), table(spark, d, "benchmark")
    return joins.union_last_wins("k", docs.select(F.col("doc_id").alias("k"), F.lit("d").alias("v")), labels.select(F.col("doc_id").alias("k"), F.concat(F.lit("l"), "quality").alias("v")), bench.select(F.col("item_id").alias("k"), F.lit("b").alias("v")))


@query("""SELECT 'union' AS part, count(*) AS rows, count(*) AS keys FROM (SELECT doc_id FROM documents UNION SELECT item_id FROM benchmark) UNION ALL SELECT 'documents', count(*), count(DISTINCT doc_id) FROM documents
UNION ALL SELECT 'labels', count(*), count(DISTINCT doc_id) FROM labels UNION ALL SELECT 'all', count(*), count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)""")
def q_key_counts(spark, d):
    docs, labels, bench = table(spark, d, "documents"), table(spark, d, "labels"), table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"))
    union = joins.union_of_keys("doc_id", docs, bench).agg(F.count(F.lit(1)).alias("rows"))
    return joins.key_counts({"documents": docs, "labels": labels}, "doc_id").unionByName(union.select(F.lit("union").alias("part"), "rows", F.col("rows").alias("keys")))


_SCENES = ("split(concat_ws(',', CASE WHEN doc_id % 2 = 0 THEN 'a' END, CASE WHEN doc_id % 3 = 0 THEN 'b' END, 'c'), ',')", "list_filter([CASE WHEN doc_id % 2 = 0 THEN 'a' END, CASE WHEN doc_id % 3 = 0 THEN 'b' END, 'c'], lambda x: x IS NOT NULL)")


@query("SELECT count(*) FILTER (WHERE doc_id % 2 = 0 OR doc_id % 3 = 0) AS overlap, count(*) AS n, count(*) FILTER (WHERE doc_id % 2 = 0) >= 3 AND count(*) FILTER (WHERE doc_id % 3 = 0) >= 3 AND count(*) >= 40 AS ready, false AS unready FROM documents")
def q_scene_pool(spark, d):
    items = table(spark, d, "documents").withColumn("scenes", F.expr(_SCENES[0]))
    overlap = joins.scene_overlap(items, ["a", "b"]).agg(F.count(F.lit(1)).alias("overlap"))
    ready = selection.ready_to_enable(items, ["a", "b"]).select("n", "ready")
    return overlap.crossJoin(ready).crossJoin(selection.ready_to_enable(items, ["a", "zz"]).select(F.col("ready").alias("unready")))


@query("SELECT source, map_from_entries(list((tier, n) ORDER BY tier))::VARCHAR AS tiers FROM (SELECT source, CASE doc_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS tier, count(*) AS n FROM documents GROUP BY ALL) GROUP BY source")
def q_tier_map(spark, d):
    rows = table(spark, d, "documents").select("source", F.expr("CASE doc_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END").alias("tier"))
    shown = F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries("tiers"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ", "), F.lit("}"))
    return aggregates.tier_map(rows, "source").select("source", shown.alias("tiers"))


@query("""SELECT lang, count(*) AS n, count(*) FILTER (WHERE k) AS kept, round(count(*) FILTER (WHERE k) / count(*)::DOUBLE, 9) AS keep_rate, round(count(*) FILTER (WHERE k AND s >= 1) / nullif(count(*) FILTER (WHERE k), 0)::DOUBLE, 9) AS identical_rate,
round(avg(s) FILTER (WHERE k), 9) AS mean_sim, min(s) FILTER (WHERE k) AS min_sim, round(count(*) FILTER (WHERE k AND s >= 0.95) / nullif(count(*) FILTER (WHERE k), 0)::DOUBLE, 9) AS rate_095
FROM (SELECT lang, doc_id % 3 <> 0 AS k, ((doc_id * 7) % 21) / 20.0::DOUBLE AS s FROM documents) GROUP BY GROUPING SETS ((), (lang))""")
def q_decision_summary(spark, d):
    rows = table(spark, d, "documents").select("lang", F.expr("CASE WHEN doc_id % 3 <> 0 THEN 'keep' ELSE 'drop' END").alias("decision"), F.expr("CAST(((doc_id * 7) % 21) / 20.0 AS DOUBLE)").alias("sim_ab"))
    out = aggregates.decision_summary(rows, ["lang"])
    return out.select("lang", "n", "kept", *[F.round(c, 9).alias(c) for c in ("keep_rate", "identical_rate", "mean_sim", "rate_095")], "min_sim")


@query("SELECT round(sum(n_chars / 3600.0 * CASE doc_id % 3 WHEN 0 THEN 200 WHEN 1 THEN 80 ELSE 0 END), 6)::DOUBLE AS estimate, sum(n_chars / 3600.0 * CASE doc_id % 3 WHEN 0 THEN 200 WHEN 1 THEN 80 ELSE 0 END) < 20000 AS shortfall FROM documents")
def q_estimated_clips(spark, d):
    plan = table(spark, d, "documents").select(F.expr("CASE doc_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END").alias("tier"), F.col("n_chars").alias("duration"))
    return aggregates.estimated_clips(plan, 20000, {"A": 200.0, "B": 80.0}).select(F.round("estimate", 6).alias("estimate"), "shortfall")


@query("""WITH e AS (SELECT event_type AS stage, ascii(event_type) * 1000 + length(event_type) AS step, round(sum(value) / 3600, 6) AS hours, count(*) AS n, max(event_id) AS latest FROM events GROUP BY event_type)
SELECT stage, hours, n, coalesce(max(latest) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > latest, false) AS stale FROM e""")
def q_progress(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("stage"), (F.ascii("event_type") * 1000 + F.length("event_type")).alias("step"), F.col("value").alias("duration"), F.col("event_id").alias("mtime"))
    return aggregates.progress(rows).select("stage", F.round("hours", 6).alias("hours"), "n", "stale")


@query("SELECT count(DISTINCT user_id) AS n_user_id, count(DISTINCT event_type) AS n_event_type FROM events")
def q_distinct_sizes(spark, d):
    return aggregates.distinct_sizes(table(spark, d, "events"), "user_id", "event_type")


@query(f"""SELECT item_id AS k, round(max(n)::DOUBLE / sum(n), 9) AS share FROM (SELECT item_id, c, count(*) AS n FROM (SELECT item_id, unnest(string_split(regexp_replace(text, '{sql.WS}', '', 'g'), '')) AS c FROM benchmark) WHERE c <> '' GROUP BY ALL) GROUP BY item_id""")
def q_most_frequent_share(spark, d):
    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("k"), "text")
    return aggregates.most_frequent_share(rows, "k", "text").select("k", F.round("share", 9).alias("share"))


@query("SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25")
def q_ranked(spark, d):
    return selection.ranked(table(spark, d, "documents").select("doc_id", "n_chars"), 25, F.desc("n_chars"), F.asc("doc_id")).select("doc_id")


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('9|' || doc_id), doc_id) AS rn FROM documents) WHERE rn <= 5")
def q_sample_per_group(spark, d):
    return selection.sample_per_group(table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id", 5, 9)


@query("SELECT shard, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM (SELECT doc_id, (doc_id % 7)::INT AS shard FROM documents) GROUP BY shard")
def q_round_robin(spark, d):
    return selection.round_robin(table(spark, d, "documents"), "doc_id", 7).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber DESC) AS rn FROM lineitem) WHERE rn = 1")
def q_largest_by(spark, d):
    return selection.largest_by(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_orderkey", "l_linenumber", "l_extendedprice")


@query("SELECT p_partkey AS k FROM part INTERSECT SELECT s_suppkey FROM supplier")
def q_split_sets(spark, d):
    return selection.split_sets(table(spark, d, "part").select(F.col("p_partkey").alias("k")), table(spark, d, "supplier").select(F.col("s_suppkey").alias("k")), "k")


@query("""WITH r AS (SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN 'f' || doc_id ELSE 'd' || doc_id END AS text FROM documents WHERE doc_id % 2 = 0 AND source IN (SELECT source FROM documents GROUP BY source HAVING min(doc_id) % 2 = 0))
SELECT source, text FROM r UNION ALL SELECT source, 'o' || doc_id FROM documents WHERE source NOT IN (SELECT source FROM documents GROUP BY source HAVING min(doc_id) % 2 = 0)""")
def q_merge_fewshot(spark, d):
    """Approved rows of some sources replace the old pool of those sources."""
    docs = table(spark, d, "documents")
    even = docs.groupBy("source").agg(F.min("doc_id").alias("m")).where("m % 2 = 0").select("source")
    full = lambda rows, text: rows.select(text.alias("text"), "lang", F.array(F.lit("x")).alias("scenes"), "source", F.lit("peak").alias("era_tag"), F.lit(True).alias("high_conf"), "doc_id")
    old = full(docs, F.concat(F.lit("o"), "doc_id")).drop("doc_id")
    reviewed = full(docs.join(even, "source", "left_semi"), F.concat(F.lit("d"), "doc_id")).withColumns({"final_text": F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" f"), "doc_id")), "status": F.when(F.col("doc_id") % 2 == 0, "approved").otherwise("open")})
    return selection.merge_fewshot(old, reviewed).select("source", "text")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) WHERE rn = 1")
def q_first_occurrences(spark, d):
    return windows.first_occurrences(table(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


@query("SELECT o_orderkey, printf('c%05d', row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) AS id FROM orders")
def q_with_sequence(spark, d):
    return windows.with_sequence(table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey"), "c%05d", ["o_custkey"], F.asc("o_orderdate"), F.asc("o_orderkey")).select("o_orderkey", "id")


@query("""WITH f AS (SELECT user_id, event_id AS i, value > 10 AS flag FROM events), g AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY i) - row_number() OVER (PARTITION BY user_id, flag ORDER BY i) AS g FROM f),
r AS (SELECT user_id, min(i) AS start, count(*) AS length FROM g WHERE flag GROUP BY user_id, g) SELECT user_id, start, length FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY length DESC, start) AS rn FROM r) WHERE rn = 1""")
def q_islands(spark, d):
    return windows.islands(table(spark, d, "events").select("user_id", F.col("event_id").alias("at"), (F.col("value") > 10).alias("flag")), "user_id", "at", "flag")


@query("""SELECT doc_id, regexp_replace(title, '[\\\\/:*?"<>|]', '_', 'g') AS safe, CASE WHEN y BETWEEN 2020 AND 2023 THEN 'peak' WHEN y >= 2024 THEN 'late' ELSE 'unknown' END AS era, 'abc' || doc_id AS plain, CASE lang WHEN 'ja' THEN 'JP' WHEN 'zh' THEN 'ZH' WHEN 'en' THEN 'EN' END AS tag, len(content) BETWEEN 4 AND 40 AS fits
FROM (SELECT doc_id, lang, 'a/b:' || doc_id || '?' || CASE WHEN doc_id % 4 = 0 THEN 'x' ELSE (2015 + doc_id % 15)::VARCHAR END AS title, CASE WHEN doc_id % 4 <> 0 AND doc_id % 15 BETWEEN 4 AND 11 THEN 2015 + doc_id % 15 END AS y, repeat('ab', (doc_id % 25)::INT) AS content FROM documents)""")
def q_titles(spark, d):
    title = F.concat(F.lit("a/b:"), "doc_id", F.lit("?"), F.when(F.col("doc_id") % 4 == 0, "x").otherwise((F.lit(2015) + F.col("doc_id") % 15).cast("string")))
    year = F.concat(F.lit("v "), F.when(F.col("doc_id") % 4 == 0, "x").otherwise((F.lit(2015) + F.col("doc_id") % 15).cast("string")))
    tagged = F.concat(F.lit("<|zh|>abc"), "doc_id", F.lit("<|end|>"))
    fits = T.in_length_range(F.concat(F.expr("repeat('ab', CAST(doc_id % 25 AS INT))"), F.lit("。 ")))
    return table(spark, d, "documents").select("doc_id", T.safe_title(title).alias("safe"), T.era_tag(year).alias("era"), T.strip_engine_tags(tagged).alias("plain"), T.language_tag(F.col("lang")).alias("tag"), fits.alias("fits"))


@query(f"SELECT doc_id, md5(regexp_replace(coalesce(text, ''), '(?:{sql.WS}|[，。！？、；：…,.!?;:·~～-])+', '', 'g')) AS short, md5(coalesce(nullif(CASE WHEN doc_id % 2 = 0 THEN {sql.strip('text')} ELSE '' END, ''), 'raw')) AS resolved FROM documents")
def q_compact_texts(spark, d):
    rows = table(spark, d, "documents")
    final = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise("  ")
    return rows.select("doc_id", F.md5(T.compact_text(F.col("text"), T.CROSSCHECK_PUNCTUATION)).alias("short"), F.md5(T.resolved_text(final, F.lit("raw"))).alias("resolved"))


def manifest_of(spark, d) -> tuple[DataFrame, DataFrame]:
    """A selected dataset and the scorecard of all rows, from documents and labels."""
    rows = table(spark, d, "documents").withColumns({"path": F.format_string("p%08d", "doc_id"), "tier": F.expr("CASE doc_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END"), "score": F.expr("CAST(50 + (doc_id * 37) % 50 AS DOUBLE)")})
    metrics = F.struct(F.expr("CAST((doc_id % 101) / 100.0 AS DOUBLE)").alias("similarity"), F.expr("CAST((doc_id % 53) / 53.0 AS DOUBLE)").alias("score_lower"))
    scores = rows.select("path", F.expr("CASE WHEN doc_id % 17 = 0 THEN 'reject' ELSE 'candidate' END").alias("decision"), "score", metrics.alias("metrics"))
    return rows.where("doc_id % 2 = 0 AND lang IN ('en', 'fr')").select("doc_id", "path", "lang", "text", F.col("source").alias("source_id"), "tier", "score"), scores


_M = "SELECT doc_id, printf('p%08d', doc_id) AS path, lang, text, source, CASE doc_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS tier, (50 + (doc_id * 37) % 50)::DOUBLE AS score, (doc_id % 101) / 100.0::DOUBLE AS sim, (doc_id % 53) / 53.0::DOUBLE AS low FROM documents"


@query(f"""WITH every AS ({_M}), m AS (SELECT * FROM every WHERE doc_id % 2 = 0 AND lang IN ('en', 'fr')),
t AS (SELECT count(*) AS n, count(*) FILTER (WHERE lang = 'en') AS p FROM m), k AS (SELECT lang, source, count(*) AS k FROM m GROUP BY ALL), o AS (SELECT count(*) FILTER (WHERE most > greatest(1, floor(0.15 * n))) AS over FROM (SELECT lang, max(k) AS most, sum(k) AS n FROM k GROUP BY lang))
SELECT 'V1' AS id, true AS pass FROM t UNION ALL SELECT 'V2', n > 0 AND p / n::DOUBLE >= 0.5 - 1e-9 FROM t UNION ALL SELECT 'V3', count(*) FILTER (WHERE doc_id % 17 = 0 OR score < 60) = 0 FROM m
UNION ALL SELECT 'V4', quantile_cont(sim, 0.5) >= 0.55 AND quantile_cont(sim, 0.1) >= 0.45 FROM m UNION ALL SELECT 'V5', (SELECT quantile_cont(low, 0.05) FROM m) >= (SELECT quantile_cont(low, 0.05) FROM every WHERE doc_id % 17 <> 0) - 0.05
UNION ALL SELECT 'V6', over = 0 FROM o UNION ALL SELECT 'V8', true FROM t""")
def q_validation(spark, d):
    """The checks but V7, whose text rules q_text_quality_reasons and q_content_key_dedupe show."""
    manifest, scores = manifest_of(spark, d)
    stats = manifest.agg(F.count(F.lit(1)).alias("n_total"), F.count_if(F.col("lang") == "en").alias("n_primary")).withColumn("shortfall", F.lit(False))
    annotation = sinks.annotation_lines(manifest, "h").select("value").withColumn("value", F.regexp_replace("value", r"^(p\d+)\|h\|", r"$1|h|ZH|"))
    checks = validation.validate(manifest, stats, scores, annotation, manifest.select("path"), 0.5, 0.15, ValidationLimits(), ScorecardConfig(), ("en", "fr"), ("ZH", "EN"))
    return checks.where("id <> 'V7'").select("id", "pass")


def _listen_sql() -> str:
    sizes = {k: int(40 * share) for k, share in validation.LAYERS.items()}
    sizes["L1"] += max(0, 40 - sum(sizes.values()))
    where = {"L1": "tier = 'B' AND lang = 'en'", "L2": "tier = 'A'", "L3": "sim BETWEEN 0.45 AND 0.45 + 0.1", "L4": "path IN (SELECT path FROM m ORDER BY score, path LIMIT (SELECT greatest(1, ceil(0.1 * count(*)))::BIGINT FROM m))", "L5": "lang = 'fr'"}
    parts, taken = [f"m AS (SELECT * FROM ({_M}) WHERE doc_id % 2 = 0 AND lang IN ('en', 'fr'))"], "SELECT NULL WHERE false"
    for layer, n in sizes.items():
        parts.append(f"{layer} AS (SELECT '{layer}' AS layer, path FROM m WHERE {where[layer]} AND path NOT IN ({taken}) ORDER BY md5('5|{layer}|' || path), path LIMIT {n})")
        taken = " UNION ALL ".join(f"SELECT path FROM {x}" for x in list(sizes)[: len(parts) - 1])
    return f"WITH {', '.join(parts)} SELECT printf('%s_%03d', layer, row_number() OVER (ORDER BY layer, path) - 1) AS id, layer, path FROM ({' UNION ALL '.join(f'SELECT * FROM {x}' for x in sizes)})"


@query(_listen_sql())
def q_listen_sample(spark, d):
    manifest, scores = manifest_of(spark, d)
    return validation.listen_sample(manifest, scores, 40, 5, 0.45, "en", "fr").select("id", "layer", "path")


@query("""WITH r AS (SELECT 'L' || (1 + doc_id % 5) AS layer, CASE WHEN doc_id % 50 = 0 THEN '' WHEN doc_id % 9 = 0 THEN '非本人' WHEN doc_id % 8 = 0 THEN 'noise' ELSE 'OK' END AS label FROM documents),
l AS (SELECT layer, count(*) AS rows, count(*) FILTER (WHERE label <> '') AS n, count(*) FILTER (WHERE label = 'OK') AS ok, count(*) FILTER (WHERE label = '非本人') AS critical FROM r GROUP BY layer)
SELECT sum(n) / sum(rows)::DOUBLE >= 0.95 AND sum(ok) / sum(n)::DOUBLE >= 0.85 AND max(ok / n::DOUBLE) FILTER (WHERE layer = 'L2') >= 0.85 AND max(ok / n::DOUBLE) FILTER (WHERE layer = 'L3') >= 0.75 AND max(critical / n::DOUBLE) < 0.1 AS pass,
round(sum(ok) / sum(n)::DOUBLE, 9) AS ok_rate, round(sum(n) / sum(rows)::DOUBLE, 9) AS coverage, round(max(critical / n::DOUBLE), 9) AS worst_critical FROM l""")
def q_listening_evaluation(spark, d):
    rows = table(spark, d, "documents").select(F.concat(F.lit("L"), F.lit(1) + F.col("doc_id") % 5).alias("layer"), F.expr("CASE WHEN doc_id % 50 = 0 THEN ' ' WHEN doc_id % 9 = 0 THEN '非本人' WHEN doc_id % 8 = 0 THEN 'noise' ELSE ' OK' END").alias("label"))
    return validation.evaluate_listening(rows).select("pass", *[F.round(c, 9).alias(c) for c in ("ok_rate", "coverage", "worst_critical")])


@query("""WITH t AS (SELECT conv_id AS session_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE role IN ('user', 'assistant'))
SELECT session_id, turn, rn <= 2 * (n // 4) AS archived FROM t""")
def q_archived_messages(spark, d):
    talk = table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "role", F.coalesce("text", F.lit("")).alias("content"))
    plan = talk.where("role IN ('user', 'assistant')").groupBy("session_id").agg((2 * F.floor(F.count(F.lit(1)) / 4)).alias("archived"))
    return session.archived_messages(talk, plan).select("session_id", "turn", "archived")


@query("""WITH t AS (SELECT conv_id AS session_id, turn, role, coalesce(text, '') AS content, row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 2 AS archived FROM conversations WHERE role IN ('user', 'assistant'))
SELECT session_id, turn FROM t WHERE NOT (archived AND session_id % 3 = 0 AND session_id % 2 = 0)""")
def q_apply_compaction(spark, d):
    """Sessions divisible by 3 have a summary; those that are odd changed after the plan, so nothing of theirs goes."""
    talk = table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "role", F.coalesce("text", F.lit("")).alias("content"))
    marked = session.archived_messages(talk, talk.select("session_id").distinct().withColumn("archived", F.lit(2)))
    digests = session.prefix_digest(marked)
    planned = digests.withColumn("previous_summary", F.lit("p"))
    current = digests.withColumn("digest", F.when(F.col("session_id") % 2 == 0, F.col("digest")).otherwise("changed")).withColumn("summary", F.lit("p"))
    summaries = digests.select("session_id", F.when(F.col("session_id") % 3 == 0, "  a  summary ").otherwise(" ").alias("summary"))
    return session.apply_compaction(marked, current, planned, summaries).select("session_id", "turn")


@query("""WITH m AS (SELECT conv_id AS session_id, 2 AS k, turn, role, coalesce(text, '') AS content FROM conversations WHERE role <> 'system' UNION ALL SELECT DISTINCT conv_id, 1, 0, 'system', 'sum' FROM conversations UNION ALL SELECT DISTINCT conv_id, 0, 0, 'system', 'facts' FROM conversations WHERE conv_id % 2 = 0)
SELECT session_id, md5(string_agg(role || ':' || content, chr(1) ORDER BY k, turn, role, content)) AS digest FROM m GROUP BY session_id""")
def q_context_order(spark, d):
    talk = table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "role", F.coalesce("text", F.lit("")).alias("content"))
    each = talk.select("session_id").distinct()
    rows = session.context(each.withColumn("content", F.lit("sum")), each.where("session_id % 2 = 0").withColumn("content", F.lit("facts")), talk.where("role <> 'system'"))
    return rows.select("session_id", F.md5(F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\x01")).alias("digest"))


_EVENTS = "SELECT user_id AS session_id, event_id % 4 AS turn, (event_id // 4) % 6 AS index, CASE event_type WHEN 'click' THEN 'sentence' WHEN 'view' THEN 'audio' WHEN 'error' THEN 'audio_error' ELSE 'done' END AS type, event_id FROM events"


def client_events(spark, d) -> DataFrame:
    kind = F.expr("CASE event_type WHEN 'click' THEN 'sentence' WHEN 'view' THEN 'audio' WHEN 'error' THEN 'audio_error' ELSE 'done' END")
    return table(spark, d, "events").select(F.col("user_id").alias("session_id"), (F.col("event_id") % 4).alias("turn"), (F.floor(F.col("event_id") / 4) % 6).alias("index"), kind.alias("type"), "event_id")


@query(f"""SELECT session_id, turn, type, index, min(place) AS first, max(place) AS last FROM (SELECT *, row_number() OVER (PARTITION BY session_id, turn ORDER BY (type = 'done')::INT, coalesce(index, 0), CASE type WHEN 'sentence' THEN 0 WHEN 'done' THEN 2 ELSE 1 END) AS place FROM ({_EVENTS}))
WHERE type IN ('sentence') GROUP BY ALL""")
def q_event_order(spark, d):
    rows = session.event_order(client_events(spark, d)).where("type = 'sentence'")
    return rows.groupBy("session_id", "turn", "type", "index").agg(F.min("place").cast("long").alias("first"), F.max("place").cast("long").alias("last"))


@query(f"SELECT session_id, turn, index FROM (SELECT session_id, turn, index, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC, index DESC) AS rn FROM ({_EVENTS}) WHERE type = 'audio') WHERE rn = 1")
def q_newest_audio(spark, d):
    return session.newest_audio(client_events(spark, d)).select("session_id", "play.turn", "play.index")


_CALL = "SELECT doc_id AS source_id, CASE doc_id % 6 WHEN 0 THEN '杂谈 2024-01-05' WHEN 1 THEN '歌回 20240301' WHEN 2 THEN '聊天 240211' WHEN 3 THEN '玩只狼 聊天' WHEN 4 THEN '今天 怎么样' ELSE 'nothing' END AS title, CASE doc_id % 2 WHEN 0 THEN 'SilverCreeper' ELSE 'x' END AS author, n_chars AS duration, 1704067200 + doc_id * 3600 AS pubdate, doc_id AS ordinal FROM documents"


@query(f"SELECT source_id, source_id % 6 IN (0, 2, 4) AS chat FROM ({_CALL})")
def q_chat_candidates(spark, d):
    return catalog_rows(spark, d).select("source_id", catalog.is_chat_candidate(F.col("title")).alias("chat"))


def catalog_rows(spark, d) -> DataFrame:
    title = F.expr("CASE doc_id % 6 WHEN 0 THEN '杂谈 2024-01-05' WHEN 1 THEN '歌回 20240301' WHEN 2 THEN '聊天 240211' WHEN 3 THEN '玩只狼 聊天' WHEN 4 THEN '今天 怎么样' ELSE 'nothing' END")
    return table(spark, d, "documents").select(F.col("doc_id").alias("source_id"), title.alias("title"), F.expr("CASE doc_id % 2 WHEN 0 THEN 'SilverCreeper' ELSE 'x' END").alias("author"), F.col("n_chars").alias("duration"), (F.lit(1704067200) + F.col("doc_id") * 3600).alias("pubdate"), F.col("doc_id").alias("ordinal"))


@query(f"""WITH r AS (SELECT *, CASE source_id % 6 WHEN 0 THEN DATE '2024-01-05' WHEN 1 THEN DATE '2024-03-01' WHEN 2 THEN DATE '2024-02-11' ELSE DATE '1970-01-01' + ((pubdate + 28800) // 86400)::INT END AS date FROM ({_CALL}))
SELECT date, source_id FROM (SELECT date, source_id, row_number() OVER (PARTITION BY date ORDER BY CASE author WHEN 'SilverCreeper' THEN 3 ELSE 0 END DESC, duration DESC, ordinal) AS rn FROM r WHERE date BETWEEN DATE '2024-01-03' AND DATE '2024-02-11') WHERE rn = 1""")
def q_one_per_date(spark, d):
    return catalog.one_per_date(catalog.in_date_range(catalog_rows(spark, d), "2024-01-03", "2024-02-11")).select("date", "source_id")


@query("""WITH p AS (SELECT doc_id AS source_id, n_chars AS duration, ((doc_id * 31) % 997)::DOUBLE AS score FROM documents WHERE doc_id % 4 IN (0, 1) AND doc_id % 3 <> 2 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))
SELECT source_id FROM (SELECT source_id, sum(duration / 3600.0) OVER w AS running, row_number() OVER w AS rn FROM p WINDOW w AS (ORDER BY score DESC, source_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE rn = 1 OR running <= 20""")
def q_to_download(spark, d):
    plan = table(spark, d, "documents").select(F.col("doc_id").alias("source_id"), F.expr("CASE doc_id % 4 WHEN 0 THEN 'planned' WHEN 1 THEN 'failed' WHEN 2 THEN 'done' ELSE 'skipped' END").alias("status"), F.expr("CASE doc_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END").alias("tier"), F.col("n_chars").alias("duration"), F.expr("CAST((doc_id * 31) % 997 AS DOUBLE)").alias("priority_score"))
    known = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("source_id"))
    return catalog.to_download(plan, known, ("A", "B"), 20.0).select("source_id")


@query("""SELECT doc_id, printf('%05d_%s.wav', row_number() OVER (ORDER BY n_chars DESC, doc_id), CASE lang WHEN 'ja' THEN 'jp' ELSE lang END) AS output_name FROM documents""")
def q_dataset_names(spark, d):
    return sinks.dataset_names(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), [F.desc("n_chars"), F.asc("doc_id")], 5).select("doc_id", "output_name")


@query("SELECT doc_id, md5(concat_ws('|', doc_id || '.wav', 'h', CASE lang WHEN 'ja' THEN 'JP' WHEN 'zh' THEN 'ZH' WHEN 'en' THEN 'EN' END, replace(text, '|', '/'))) AS line FROM documents")
def q_annotation_lines(spark, d):
    return sinks.annotation_lines(table(spark, d, "documents").withColumn("path", F.concat("doc_id", F.lit(".wav"))), "h").select("doc_id", F.md5("value").alias("line"))


@query("SELECT printf('%03d_en.wav', doc_id) AS name FROM documents WHERE doc_id < 1000 AND doc_id % 2 = 1")
def q_stale_outputs(spark, d):
    docs = table(spark, d, "documents")
    existing = docs.where("doc_id < 1000").select(F.format_string("%03d_en.wav", "doc_id").alias("name")).unionByName(docs.select(F.concat(F.lit("note"), "doc_id", F.lit(".txt")).alias("name")))
    return sinks.stale_outputs(existing, docs.where("doc_id % 2 = 0").select(F.format_string("%03d_en.wav", "doc_id").alias("output_name")))


@query("""SELECT name, part, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY part, ordinal) AS rn FROM (SELECT source AS name, 0 AS part, doc_id AS ordinal FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT lang, 1, doc_id FROM documents UNION ALL SELECT source, 1, doc_id FROM documents)) WHERE rn = 1""")
def q_append_whitelist(spark, d):
    docs = table(spark, d, "documents")
    new = docs.select(F.col("lang").alias("name"), F.col("doc_id").alias("ordinal")).unionByName(docs.select(F.col("source").alias("name"), F.col("doc_id").alias("ordinal")))
    return sinks.append_whitelist(docs.where("doc_id % 2 = 0").select(F.col("source").alias("name"), F.col("doc_id").alias("ordinal")), new).select("name", "place.part", "place.ordinal")


@query("SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR quality = 0")
def q_require_ready(spark, d):
    assets = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("name"))
    statuses = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("name"), F.when(F.col("quality") == 1, "ready").otherwise("probe_error").alias("status"))
    return sinks.require_ready(assets, statuses).select("doc_id")


@query("SELECT d.doc_id AS source_id, coalesce('q' || quality, 'planned') AS status FROM documents d LEFT JOIN labels USING (doc_id)")
def q_mark_status(spark, d):
    plan = table(spark, d, "documents").select(F.col("doc_id").alias("source_id"), F.lit("planned").alias("status"))
    return sinks.mark_status(plan, table(spark, d, "labels").select(F.col("doc_id").alias("source_id"), F.concat(F.lit("q"), "quality").alias("status")))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def q_pending(spark, d):
    return sinks.pending(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id", ("quality", 1))


@query("""SELECT event_id, 'data: {"type":"' || event_type || '","index":' || user_id || '}' || chr(10) || chr(10) AS event, event_type AS type_read FROM events""")
def q_sse_events(spark, d):
    rows = table(spark, d, "events").withColumn("event", sinks.sse_event(F.struct(F.col("event_type").alias("type"), F.col("user_id").alias("index"))))
    read = F.from_json(F.regexp_extract(readers.split_events(F.col("event"))["events"][0], r"^data:\s?(.*)$", 1), "type STRING")["type"]
    return rows.select("event_id", "event", read.alias("type_read"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'sentence' WHEN 'view' THEN 'done' END AS type, CASE WHEN event_type IN ('click', 'view') THEN user_id::INT END AS index, event_id % 3 = 0 AS open FROM events")
def q_event_parse(spark, d):
    """Blocks of an event stream: typed events, and whether a block is left open at the end."""
    kind = F.expr("CASE event_type WHEN 'click' THEN 'sentence' WHEN 'view' THEN 'done' ELSE event_type || 'x' END")
    raw = F.concat(F.lit('data: {"type":"'), kind, F.lit('","index":'), "user_id", F.lit("}\n\n"), F.when(F.col("event_id") % 3 == 0, "data: {").otherwise(""))
    parts = readers.split_events(raw)
    event = readers.parse_event(parts["events"][0])
    return table(spark, d, "events").select("event_id", event["type"].alias("type"), event["index"].alias("index"), (parts["rest"] != "").alias("open"))


@query("SELECT event_id, event_type AS delta FROM events WHERE event_id % 5 < 3")
def q_stream_deltas(spark, d):
    text = F.concat(F.lit('"'), "event_type", F.lit('"'))
    form = lambda head, tail: F.concat(F.lit("data: " + head), text, F.lit(tail))
    value = F.when(F.col("event_id") % 5 == 0, form('{"choices":[{"delta":{"content":', "}}]}")).when(F.col("event_id") % 5 == 1, form('{"delta":{"text":', "}}")).when(F.col("event_id") % 5 == 2, form('{"candidates":[{"content":{"parts":[{"text":', "}]}}]}")).when(F.col("event_id") % 5 == 3, "data: [DONE]").otherwise(": ping")
    return readers.stream_deltas(table(spark, d, "events").select("event_id", value.alias("value"))).select("event_id", "delta")


@query("SELECT source_id, CASE WHEN source_id % 2 = 0 THEN 't1' WHEN source_id % 3 = 0 THEN 't2' ELSE '' END AS title, CASE WHEN source_id % 2 = 0 THEN source_id WHEN source_id % 3 = 0 THEN source_id + 1 ELSE 0 END AS duration FROM (SELECT doc_id AS source_id FROM documents)")
def q_select_candidates(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("source_id"), F.col("doc_id").alias("ordinal"))
    cache = lambda k, title, add: docs.where(f"source_id % {k} = 0").select("source_id", "ordinal", F.lit(title).alias("title"), F.lit("a").alias("author"), (F.col("source_id") + add).alias("duration"), F.lit(0).cast("long").alias("pubdate"), F.lit(0).cast("long").alias("play"))
    return readers.select_candidates(docs, cache(2, "t1", 0), cache(3, "t2", 1)).select("source_id", "title", "duration")


@query("SELECT doc_id AS source_id, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS search FROM documents")
def q_merge_searches(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("source_id"), F.col("doc_id").alias("ordinal"))
    return readers.merge_searches(docs.withColumn("search", F.lit(1)), docs.where("source_id % 3 = 0").withColumn("search", F.lit(2))).select("source_id", "search")


@query("SELECT 'n' || doc_id AS name, 'p' || (doc_id + 1) AS phones FROM documents WHERE doc_id % 4 <> 0")
def q_parse_features(spark, d):
    rows = table(spark, d, "documents").select(F.explode(F.array(F.lit(0), F.lit(1))).alias("k"), "doc_id")
    lines = rows.select((F.col("doc_id") * 2 + F.col("k")).alias("ordinal"), F.when(F.col("doc_id") % 4 == 0, "broken").otherwise(F.concat(F.lit("n"), "doc_id", F.lit("\tp"), F.col("doc_id") + F.col("k"), F.lit("\tx"))).alias("value"))
    return readers.parse_features(lines)


@query("SELECT source AS name, min(doc_id) AS ordinal FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id = 0) GROUP BY source")
def q_missing_assets(spark, d):
    """Names of a list with blanks, comments and repeats that have no file."""
    docs = table(spark, d, "documents")
    value = F.when(F.col("doc_id") % 7 == 6, F.concat(F.lit("  # "), "source")).otherwise(F.concat(F.lit(" "), "source", F.lit("\t")))
    lines = docs.select(F.col("doc_id").alias("ordinal"), F.lit("").alias("value")).unionByName(docs.select(F.col("doc_id").alias("ordinal"), value.alias("value"))).unionByName(docs.select(F.col("doc_id").alias("ordinal"), F.col("source").alias("value")))
    names = readers.training_assets(lines)
    return readers.missing_assets(names, docs.where("doc_id = 0").select(F.concat(F.lit("/x/"), "source").alias("path"))).select("name", "ordinal")


@query("SELECT style, audio, prompt_text, lang, clip_id FROM (VALUES ('温柔', 'a.wav', 'hello', 'zh', '温柔'), ('俏皮', 'b.wav', 'hi', 'ja', 'c7')) AS t(style, audio, prompt_text, lang, clip_id)")
def q_style_clips(spark, d):
    bank = spark.sql("SELECT map('温柔', struct(struct('a.wav' AS audio, ' hello ' AS prompt_text, CAST(NULL AS STRING) AS lang, CAST(NULL AS STRING) AS id) AS primary), '俏皮', struct(struct('b.wav' AS audio, 'hi' AS prompt_text, 'ja' AS lang, 'c7' AS id) AS primary), 'odd', struct(struct('c.wav' AS audio, 'x' AS prompt_text, 'zh' AS lang, 'z' AS id) AS primary), '惊讶', struct(struct('' AS audio, 'x' AS prompt_text, 'zh' AS lang, 'z' AS id) AS primary)) AS styles")
    return readers.style_clips(bank)


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'w.wav' ELSE 'd.wav' END AS clip_audio FROM conversations")
def q_reference_clips(spark, d):
    clips = spark.sql("SELECT * FROM VALUES ('温柔', 'w.wav'), ('日常', 'd.wav') AS t(style, audio)")
    styles = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, "温柔").when(F.col("turn") % 3 == 1, "odd").otherwise("日常").alias("style"))
    each = retrieval.reference_clip(styles.select("style").distinct(), clips, "日常")
    return styles.join(each, "style").select("conv_id", "turn", "clip_audio")


@query("SELECT shard, ordinal, value FROM (SELECT doc_id % 4 AS shard, doc_id AS ordinal, CASE WHEN doc_id % 5 = 0 THEN 'new' || doc_id ELSE 'old' || doc_id END AS value FROM documents) UNION ALL SELECT -1, -1, 'head'")
def q_merge_parts(spark, d):
    """Lines of shards with regenerated ones in place, in order: the ordinal of each merged line is checked by its value."""
    docs = table(spark, d, "documents").select((F.col("doc_id") % 4).alias("shard"), F.col("doc_id").alias("ordinal"), F.col("doc_id").cast("string").alias("name"), F.concat(F.lit("old"), "doc_id").alias("value"))
    new = sinks.replace_lines(docs.select("ordinal", "name", "value"), docs.where("ordinal % 5 = 0").select("name", F.concat(F.lit("new"), "ordinal").alias("value")))
    merged = sinks.merge_parts(docs.select("shard", "ordinal", "name").join(new.select("name", "value"), "name"), "head")
    number = F.regexp_extract("value", r"(\d+)$", 1)
    place = F.when(F.col("value") == "head", F.lit(-1)).otherwise(number.try_cast("long"))
    return merged.select(F.when(F.col("value") == "head", F.lit(-1).cast("long")).otherwise(place % 4).alias("shard"), place.cast("long").alias("ordinal"), "value")


@query("""SELECT conv_id AS query_id, CASE WHEN conv_id % 3 = 0 THEN '[hint]' ELSE concat_ws('+', CASE WHEN conv_id % 2 = 0 THEN '<facts>|- f1|- f2|</facts>' END, CASE WHEN conv_id % 5 = 0 THEN '<examples>|- e1|</examples>' END) END AS shown FROM (SELECT DISTINCT conv_id FROM conversations)""")
def q_compose_context(spark, d):
    asked = table(spark, d, "conversations").select(F.col("conv_id").alias("query_id")).distinct()
    fact = lambda rows, i, hits, s=False: rows.select("query_id", F.lit(s).alias("sensitive"), F.lit(i).alias("fact_id"), F.lit(i).alias("fact"), F.lit(hits).cast("long").alias("hits"))
    even = asked.where("query_id % 2 = 0")
    facts = fact(even, "f2", 1).unionByName(fact(even, "f1", 3)).unionByName(fact(asked.where("query_id % 3 = 0"), "x", 0, True))
    examples = asked.where("query_id % 5 = 0").select("query_id", F.lit(1).alias("rank"), F.lit("e1").alias("text"))
    out = retrieval.compose_context(asked, facts, examples, "[hint]")
    return out.select("query_id", F.array_join(F.transform("messages", lambda m: F.replace(m["content"], F.lit("\n"), F.lit("|"))), "+").alias("shown"))
