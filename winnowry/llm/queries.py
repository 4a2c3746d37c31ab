"""The operators' queries over the whole tables, with production parameters, and their SQL where SQL can express them."""
from __future__ import annotations

import re

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe_words, embedding_dedup, exact_dedup, fill_in_middle, langid, licenses, line_dedup, minhash_dedup, mixing, packing, quality, warc

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORD_TOKENIZER, PIECE_MODEL = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(of: int) -> F.Column:
    """crc32 of the document id as text, modulo ``of``: the fold of a document."""
    return F.crc32(F.col("doc_id").cast("string")) % of


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), remainder(3) != 1)
    scored = quality.score_documents(docs, model)
    return scored.select("doc_id", (remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


OP2_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, remainder(4) != 2)
    return langid.predict(docs, model).select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents")).drop("spans")


def _op6_sql() -> str:
    """The phrases by position in the list of words, the templates as regular expressions over words each followed by a space."""
    base = " UNION ALL ".join(
        f"SELECT doc_id, i - 1 AS place, '{label}' AS label FROM words, unnest(range(1, len(w) + 1)) AS t(i) WHERE " + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split()))
        for phrase, label in licenses.PHRASES.items()
    )
    # markup put straight into a regular expression, apart from the operator's own reading of it
    marks = {"<<beginOptional>>": "(?:", "<<endOptional>>": ")?"}
    item = lambda x: marks.get(x) or ("(?:[^ ]+ ){%s,%s}" % re.search(r"(\d+)-(\d+)", x).groups() if x.startswith("<<") else x.lower() + " ")
    pattern = lambda template: "".join(map(item, re.findall(r"<<[^>]*>>|[0-9A-Za-z]+", template)))
    own = " UNION ALL ".join(f"SELECT doc_id, '{label}' AS label FROM plain WHERE regexp_matches(t, '(^| ){pattern(template)}')" for label, template in licenses.TEMPLATES.items())
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
plain AS (SELECT doc_id, array_to_string(w, ' ') || ' ' AS t FROM words),
base AS ({base}),
own AS ({own}),
b AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY doc_id),
a AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM base UNION ALL SELECT doc_id, label FROM own) GROUP BY doc_id)
SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN words.doc_id IN (SELECT doc_id FROM own) THEN 1.0::DOUBLE WHEN n_base IS NOT NULL THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score
FROM words LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id)
"""


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.duplicate_lines(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(table(spark, sf_dir, "documents"), TOKENIZER)


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op5_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive of all pages against a replica with known damage: letters overwritten in some bodies, the ends of some files cut off."""
    pages = table(spark, sf_dir, "pages")
    rotten = F.pmod("page_id", F.lit(101)) == 7
    cut = (F.pmod("page_id", F.lit(warc.SLOTS)) >= 500) & (F.pmod(F.floor(F.col("page_id") / warc.SLOTS), F.lit(3)) == 0)
    replica = pages.where(~cut).withColumn("html", F.when(rotten, F.translate("html", "et", "xy")).otherwise(F.col("html")))
    return warc.fixity(pages, replica)


def _op5_sql() -> str:
    def leaves(rows: str) -> str:
        return f"""SELECT page_id, CAST(floor(page_id / {warc.SLOTS}.0) AS BIGINT) AS file, page_id % {warc.SLOTS} AS slot, length, digest,
            CAST(coalesce(sum(length) OVER (PARTITION BY CAST(floor(page_id / {warc.SLOTS}.0) AS BIGINT) ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS low
            FROM (SELECT page_id, CAST(octet_length(encode(t)) AS BIGINT) AS length, sha256(t) AS digest FROM (SELECT page_id,
            'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: '
            || octet_length(encode(coalesce(html, ''))) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS t FROM ({rows})))"""

    levels = ["l0 AS (SELECT file, slot AS node, low, low + length AS high, digest FROM a)"]
    for k in range(1, warc.LEVELS + 1):
        levels.append(f"l{k} AS (SELECT file, node // {warc.FANOUT} AS node, min(low) AS low, max(high) AS high, sha256(min(low) || '-' || max(high) || ':' || string_agg(digest, ',' ORDER BY node)) AS digest FROM l{k - 1} GROUP BY file, node // {warc.FANOUT})")
    damaged = f"""SELECT page_id, url, CASE WHEN page_id % 101 = 7 THEN translate(html, 'et', 'xy') ELSE html END AS html FROM pages
        WHERE NOT (page_id % {warc.SLOTS} >= 500 AND CAST(floor(page_id / {warc.SLOTS}.0) AS BIGINT) % 3 = 0)"""
    return f"""WITH a AS ({leaves("SELECT page_id, url, html FROM pages")}), b AS ({leaves(damaged)}), {", ".join(levels)}
SELECT a.page_id, a.file, a.slot, CAST(1 AS BIGINT) AS n_records, a.low AS "offset", a.length, a.digest AS record_sha256,
       CASE WHEN b.digest IS NULL THEN 'missing' WHEN a.digest <> b.digest THEN 'corrupt' WHEN a.low <> b.low THEN 'moved' ELSE 'ok' END AS status, r.digest AS file_root
FROM a LEFT JOIN b ON a.page_id = b.page_id LEFT JOIN l{warc.LEVELS} r ON a.file = r.file"""


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.plan(table(spark, sf_dir, "documents"))
    return mixed.withColumns({"weight": F.round("weight", 9), "repeats": F.round("repeats", 9)})


def op10_sql(documents: str = "documents") -> str:
    """The exponent by bisection over the same grid, in a recursive query."""
    sums = lambda k: f"(SELECT ln(sum(pow(p, {k} / {mixing.GRID}.0))) - {k} / {mixing.GRID}.0 * sum(pow(p, {k} / {mixing.GRID}.0) * ln(p)) / sum(pow(p, {k} / {mixing.GRID}.0)) >= {mixing.TARGET_ENTROPY} * ln(count(*)) FROM shares)"
    few = lambda k: f"(SELECT max(pow(p, {k} / {mixing.GRID}.0 - 1)) / sum(pow(p, {k} / {mixing.GRID}.0)) <= {mixing.MAX_REPEATS} FROM shares)"
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n_tokens FROM {documents}),
s AS (SELECT source, sum(n_tokens)::BIGINT AS tokens, count(*) AS n_docs FROM d GROUP BY source),
shares AS (SELECT tokens / (SELECT sum(tokens)::DOUBLE FROM s) AS p FROM s WHERE tokens > 0),
e(low, high) AS (SELECT 0::BIGINT, {mixing.GRID + 1}::BIGINT UNION ALL
    SELECT CASE WHEN {sums("((low + high) // 2)")} THEN (low + high) // 2 ELSE low END, CASE WHEN {sums("((low + high) // 2)")} THEN high ELSE (low + high) // 2 END FROM e WHERE high - low > 1),
r(low, high) AS (SELECT -1::BIGINT, {mixing.GRID}::BIGINT UNION ALL
    SELECT CASE WHEN {few("((low + high) // 2)")} THEN low ELSE (low + high) // 2 END, CASE WHEN {few("((low + high) // 2)")} THEN (low + high) // 2 ELSE high END FROM r WHERE high - low > 1),
a AS (SELECT greatest((SELECT least(max(low), {mixing.GRID}) FROM e), (SELECT min(high) FROM r), 0) / {mixing.GRID}.0 AS a),
w AS (SELECT source, tokens, ceil(n_docs / {mixing.BLOCK_DOCS}.0)::BIGINT AS blocks, CASE WHEN tokens > 0 THEN pow(tokens / (SELECT sum(tokens)::DOUBLE FROM s), (SELECT a FROM a)) / (SELECT sum(pow(p, (SELECT a FROM a))) FROM shares) END AS weight FROM s),
q AS (SELECT *, coalesce(floor(round(weight * (SELECT sum(tokens)::DOUBLE FROM s), 3))::BIGINT, 0) AS quota FROM w),
x AS (SELECT doc_id, source, n_tokens, weight, tokens, quota, CASE WHEN tokens > 0 THEN quota // tokens ELSE 0 END AS passes, md5(concat_ws('|', '{mixing.SEED}', source, doc_id::VARCHAR)) AS h, blocks FROM d JOIN q USING (source)),
y AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % blocks AS block FROM x),
z AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY source ORDER BY block, h, doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM y)
SELECT doc_id, source, n_tokens, round(weight, 9) AS weight, CASE WHEN tokens > 0 THEN round(quota / tokens, 9) END AS repeats,
       CASE WHEN n_tokens = 0 THEN 1 ELSE passes + (start + n_tokens <= quota - passes * tokens)::BIGINT END AS copies, block, start FROM z"""


def op11_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_words.encode_and_decode(table(spark, sf_dir, "documents"), WORD_TOKENIZER)
    return coded.select(F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned, _ = alignment.align_tokenizers(table(spark, sf_dir, "documents"), TOKENIZER, PIECE_MODEL)
    return aligned.select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return done.select(
        F.col("id").alias("doc_id"), "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        digest(F.col("output")).alias("output_sha256"), digest(fill_in_middle.restore(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || doc_id::VARCHAR) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS p, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
             ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, len(p)::BIGINT AS n, least(h1 % (len(p) + 1), h2 % (len(p) + 1)) AS low, greatest(h1 % (len(p) + 1), h2 % (len(p) + 1)) AS high,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
s AS (SELECT *, coalesce(array_to_string(p[1:low], ''), '') AS a, coalesce(array_to_string(p[low + 1:high], ''), '') AS b, coalesce(array_to_string(p[high + 1:], ''), '') AS c FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b WHEN 'spm' THEN '<S>' || c || '<P>' || a || '<M>' || b ELSE text END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM s
"""


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier, op2_exact_dedup, op3_language_id, op4_embedding_dedup, op5_warc_fixity, op6_license_scan, op7_line_dedup, op8_best_fit_packing, op9_minhash_dedup, op10_source_mixing,
        op11_bpe_round_trip, op12_tokenizer_alignment, op13_fill_in_middle,
    )
}
ORACLES = {"op2_exact_dedup": OP2_SQL, "op5_warc_fixity": _op5_sql(), "op6_license_scan": _op6_sql(), "op10_source_mixing": op10_sql(), "op13_fill_in_middle": OP13_SQL}
