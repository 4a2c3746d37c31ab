"""Streams over the corpus tables that are stopped and go on, the substring join, the table function and the snapshot tables, with their SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from winnowry.config import CompactionLimits
from winnowry.functions import conversion, slicing
from winnowry.operators import substrings
from winnowry.plans.corpus_queries import table
from winnowry.sources import event_lines, readers, scratch, snapshots
from winnowry.streaming import chain, event_time, stateful

QUERIES: dict = {}
ORACLES: dict = {}
PARTS = 2


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


# --- recorded model output -----------------------------------------------------------------------------------------------

_LINES = """SELECT user_id AS request_id, 1 + event_id // 1000 AS attempt, event_id, event_type = 'click' AND 1 + event_id // 1000 > user_id % 4 AS said FROM events"""


def recorded_lines(spark, d) -> DataFrame:
    """(part, value): recorded lines of model output, two thirds of them with a delta only after some attempts."""
    said = F.expr("event_type = 'click' AND 1 + event_id DIV 1000 > user_id % 4")
    delta = F.concat(F.lit('data: {"choices": [{"delta": {"content": "'), F.col("event_id"), F.lit('"}}]}'))
    line = F.struct(F.col("user_id").alias("request_id"), F.expr("1 + event_id DIV 1000").alias("attempt"), F.col("event_id").alias("seq"), F.when(said, delta).otherwise("data: [DONE]").alias("line"))
    return table(spark, d, "events").select((F.col("event_id") % PARTS).alias("part"), F.to_json(line).alias("value"))


def _deltas(lines: DataFrame) -> DataFrame:
    r = F.from_json("value", "request_id long, attempt long, seq long, line string")
    rows = lines.select(r.alias("r")).select(F.col("r.request_id").cast("string").alias("request_id"), "r.attempt", "r.seq", F.col("r.line").alias("value"))
    return readers.stream_deltas(rows, keep_all=True).select("request_id", "attempt", "seq", "delta")


@query(f"""WITH l AS ({_LINES}), a AS (SELECT request_id, min(attempt) AS attempt FROM l WHERE said AND event_id % {PARTS} = 0 GROUP BY 1),
b AS (SELECT request_id, min(attempt) AS attempt FROM l WHERE said GROUP BY 1), c AS (SELECT b.request_id, coalesce(a.attempt, b.attempt) AS attempt FROM b LEFT JOIN a USING (request_id))
SELECT request_id::VARCHAR AS request_id, attempt, count(*) AS n, md5(string_agg(event_id, ',' ORDER BY event_id)) AS digest FROM l JOIN c USING (request_id, attempt) WHERE said GROUP BY 1, 2""")
def q_recorded_answers(spark, d):
    """Lines of model output in segments, read by the data source as a stream that is stopped after the first segments and goes on with the next."""
    lines = recorded_lines(spark, d)
    source, out, checkpoint = (scratch.scratch_path(spark, f"answers_{x}") for x in ("in", "out", "at"))
    with stateful.state_store(spark):
        for k in range(PARTS):
            lines.where(F.col("part") == k).select("value").write.text(f"{source}/{k:04d}")
            chain.run_available(stateful.answers(_deltas(event_lines.stream_event_lines(spark, source))), out, checkpoint)
    digest = F.md5(F.array_join(F.transform(F.sort_array(F.collect_list("seq")), lambda x: x.cast("string")), ","))
    return spark.read.parquet(out).groupBy("request_id", "attempt").agg(F.count(F.lit(1)).alias("n"), digest.alias("digest"))


@query(f"SELECT request_id, count(*) AS n, count(*) FILTER (WHERE said) AS n_said, sum(event_id)::BIGINT AS ids FROM ({_LINES}) GROUP BY 1")
def q_event_lines(spark, d):
    """The same lines as a batch, in ranges of 64 KB."""
    source = scratch.scratch_path(spark, "lines")
    recorded_lines(spark, d).select("value").write.text(source)
    rows = _deltas(event_lines.read_event_lines(spark, source, 64 << 10))
    return rows.groupBy(F.col("request_id").cast("long").alias("request_id")).agg(F.count(F.lit(1)).alias("n"), F.count("delta").alias("n_said"), F.sum("seq").alias("ids"))


# --- conversation memory -------------------------------------------------------------------------------------------------

LIMITS = CompactionLimits(trigger_turns=3, trigger_chars=4000, recent_turns=1)
#: A commit of two messages comes after every fourth message; conversations divisible by 5 commit a wrong prefix from their second on.
_TALK = "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, coalesce(text, '')) - 1 AS i, role, coalesce(text, '') AS content FROM conversations WHERE role IN ('user', 'assistant')"
_MEMORY_SQL = f"""WITH m AS ({_TALK}), c AS (SELECT conv_id, i, i // 4 AS k FROM m WHERE i % 4 = 3),
done AS (SELECT m.conv_id, m.i, least(m.i // 4, CASE WHEN m.conv_id % 5 = 0 THEN 1 ELSE 1000000 END) AS k FROM m),
all_ AS (SELECT conv_id, list(role ORDER BY i) AS roles, list(content ORDER BY i) AS contents FROM m GROUP BY 1),
s AS (SELECT d.conv_id, d.i, d.k, a.roles[2 * d.k + 1:d.i + 1] AS roles, a.contents[2 * d.k + 1:d.i + 1] AS contents FROM done d JOIN all_ a USING (conv_id)),
t AS (SELECT *, (len(roles) - (roles[len(roles)] = 'user')::INT) // 2 AS turns, list_sum(list_transform(contents, lambda x: length(x))) AS chars FROM s),
p AS (SELECT *, CASE WHEN (turns >= {LIMITS.trigger_turns} OR chars >= {LIMITS.trigger_chars}) AND turns > {LIMITS.recent_turns} THEN 2 * (turns - {LIMITS.recent_turns}) ELSE 0 END AS n FROM t),
plan AS (SELECT conv_id, 2 * i AS seq, 'plan' AS kind, n::INT AS archived, sha256(array_to_string(list_transform(range(1, n + 1), lambda k: roles[k] || chr(31) || contents[k]), chr(30))) AS digest, len(roles)::INT AS kept FROM p WHERE n > 0),
tried AS (SELECT c.conv_id, 2 * c.i + 1 AS seq, c.k, c.i, c.conv_id % 5 <> 0 OR c.k = 0 AS good, a.roles, a.contents FROM c JOIN all_ a USING (conv_id)),
com AS (SELECT conv_id, seq, CASE WHEN good THEN 'committed' ELSE 'stale' END AS kind, 2 AS archived,
    CASE WHEN conv_id % 5 = 0 AND k > 0 THEN 'wrong' ELSE sha256(array_to_string(list_transform(range(2 * k + 1, 2 * k + 3), lambda j: roles[j] || chr(31) || contents[j]), chr(30))) END AS digest,
    (i + 1 - 2 * (CASE WHEN conv_id % 5 = 0 THEN 1 ELSE k + 1 END))::INT AS kept FROM tried)
SELECT conv_id::VARCHAR AS session_id, seq, kind, archived, digest, kept FROM plan UNION ALL SELECT conv_id::VARCHAR, seq, kind, archived, digest, kept FROM com"""


def memory_turns(spark, d) -> DataFrame:
    """Messages of the conversations and commits of their summaries, as ``stateful.memory`` takes them, with the part in which they come. All conversations
    go on at once, a message a second, so no row of a later part is behind the rows of an earlier one."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", F.coalesce("text", F.lit("")))) - 1
    talk = table(spark, d, "conversations").where("role IN ('user', 'assistant')").select("conv_id", place.alias("i"), "role", F.coalesce("text", F.lit("")).alias("content"))
    said = F.concat("role", F.lit("\x1f"), "content")
    pair = Window.partitionBy("conv_id", F.floor(F.col("i") / 2)).orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    digest = F.sha2(F.array_join(F.collect_list(said).over(pair), "\x1e").cast("binary"), 256)
    digests = talk.withColumn("digest", digest).where("i % 2 = 0").select("conv_id", (F.col("i") / 2).cast("long").alias("k"), "digest")
    when = lambda i: F.timestamp_seconds(F.lit(1704067200) + i)
    messages = talk.select("conv_id", (F.col("i") * 2).cast("long").alias("seq"), F.col("role").alias("kind"), "content", F.lit(None).cast("int").alias("archived"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("string").alias("previous"), when(F.col("i")).alias("ts"))
    due = talk.where("i % 4 = 3").select("conv_id", "i", F.floor(F.col("i") / 4).cast("long").alias("k")).join(digests, ["conv_id", "k"])
    wrong = (F.col("conv_id") % 5 == 0) & (F.col("k") > 0)
    commits = due.select(
        "conv_id", (F.col("i") * 2 + 1).cast("long").alias("seq"), F.lit("commit").alias("kind"), F.concat(F.lit("summary "), "k").alias("content"), F.lit(2).alias("archived"), F.when(wrong, "wrong").otherwise(F.col("digest")).alias("digest"),
        F.when(F.col("k") > 0, F.concat(F.lit("summary "), F.col("k") - 1)).alias("previous"), when(F.col("i")).alias("ts"),
    )
    rows = messages.unionByName(commits)
    return rows.select((F.col("seq") > 8).cast("int").alias("part"), F.col("conv_id").cast("string").alias("session_id"), *rows.columns[1:])


@query(_MEMORY_SQL)
def q_session_memory(spark, d):
    """Plans and optimistic commits of every conversation, by the stateful stream in two parts."""
    out = chain.in_parts(memory_turns(spark, d), "part", 2, lambda df: stateful.memory(df, LIMITS, idle="365 days"), "memory")
    return out.where("kind <> 'evicted'")


MOST_SESSIONS = 6


@query(f"""WITH u AS (SELECT user_id % 4 AS shard, user_id AS s, event_id AS seq FROM events),
n AS (SELECT *, lead(seq) OVER (PARTITION BY shard, s ORDER BY seq) AS again FROM u),
f AS (SELECT n.shard, n.s, n.seq, n.again, x.s AS other, min(x.seq) AS first FROM n JOIN u x ON n.shard = x.shard AND x.seq > n.seq AND (n.again IS NULL OR x.seq < n.again) AND x.s <> n.s GROUP BY ALL),
r AS (SELECT shard, s, seq, first, row_number() OVER (PARTITION BY shard, s, seq ORDER BY first) AS k FROM f)
SELECT shard, s::VARCHAR AS session_id, first AS seq FROM r WHERE k = {MOST_SESSIONS}""")
def q_evicted_longest(spark, d):
    """Sessions that go when a shard holds too many: the longest unused first."""
    uses = table(spark, d, "events").select((F.col("event_id") > 3000).cast("int").alias("part"), (F.col("user_id") % 4).alias("shard"), F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("seq"), F.lit("use").alias("kind"))
    return chain.in_parts(uses, "part", 2, lambda df: stateful.evictions(df, MOST_SESSIONS), "evictions")


_DENSE = """SELECT user_id AS session_id, event_id % 4 AS turn, event_id, row_number() OVER (PARTITION BY user_id, event_id % 4 ORDER BY event_id) - 1 AS p FROM events"""


@query(f"""SELECT session_id::VARCHAR AS session_id, turn, p AS place, CASE WHEN p % 2 = 0 THEN 'sentence' ELSE 'audio' END AS type, (p // 2)::INT AS index, event_id, 'on time' AS state FROM ({_DENSE})""")
def q_ordered_emission(spark, d):
    """Every turn's events arrive in the order of a digest, in two parts, and come out as a client plays them."""
    place = F.row_number().over(Window.partitionBy("user_id", F.col("event_id") % 4).orderBy("event_id")) - 1
    rows = table(spark, d, "events").select("user_id", (F.col("event_id") % 4).alias("turn"), "event_id", place.alias("p"), F.md5(F.col("event_id").cast("string")).alias("h"))
    rows = rows.select(
        (F.col("h") > "8").cast("int").alias("part"), F.col("user_id").cast("string").alias("session_id"), "turn", F.floor(F.col("p") / 2).cast("int").alias("index"), F.when(F.col("p") % 2 == 0, "sentence").otherwise("audio").alias("type"), "event_id",
        F.timestamp_seconds(F.lit(1704067200)).alias("ts"),
    )
    return chain.in_parts(rows.orderBy("h"), "part", 2, lambda df: stateful.in_order(df), "ordered")


# --- event time ----------------------------------------------------------------------------------------------------------

END = "2100-01-01 00:00:00"


def timed(spark, d) -> DataFrame:
    """Events with the part in which they come, and a last row far ahead, which closes all windows."""
    events = table(spark, d, "events").select((F.col("event_id") % 10 >= 5).cast("int").alias("half"), "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    middle = events.agg(F.expr("timestamp_micros(CAST((unix_micros(min(ts)) + unix_micros(max(ts))) / 2 AS BIGINT))").alias("middle"))
    rows = events.crossJoin(F.broadcast(middle)).select((F.col("ts") > F.col("middle")).cast("int").alias("part"), "event_id", "ts", "user_id", "event_type", "value")
    last = spark.range(1).select(F.lit(2).alias("part"), F.lit(-1).cast("long").alias("event_id"), F.lit(END).cast("timestamp").alias("ts"), F.lit(-1).cast("long").alias("user_id"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value"))
    return rows.unionByName(last)


def _local(name: str) -> F.Column:
    return F.col(name).cast("timestamp_ntz").alias(name)


@query("""WITH g AS (SELECT *, (ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 4 HOUR)::INT AS near FROM events),
s AS (SELECT *, sum(1 - coalesce(near, 0)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 4 HOUR AS stop, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k""")
def q_session_windows(spark, d):
    out = chain.in_parts(timed(spark, d), "part", 3, lambda df: event_time.session_windows(df, "4 hours", "1 hour", "user_id"), "session_windows")
    return out.where("user_id >= 0").select("user_id", _local("start"), F.col("end").cast("timestamp_ntz").alias("stop"), "n", F.round("total", 4).alias("total"))


@query("""SELECT event_type, start, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT event_type, value, time_bucket(INTERVAL 2 HOUR, ts) - k * INTERVAL 2 HOUR AS start FROM events, range(3) AS t(k)) GROUP BY ALL""")
def q_sliding_counts(spark, d):
    out = chain.in_parts(timed(spark, d), "part", 3, lambda df: event_time.sliding_counts(df, "6 hours", "2 hours", "1 hour", "event_type"), "sliding")
    return out.where("event_type <> 'end'").select("event_type", _local("start"), "n", F.round("total", 4).alias("total"))


@query("""SELECT a.user_id, a.event_id AS first_id, b.event_id AS then_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 2 HOUR WHERE a.event_type = 'view' AND b.event_type = 'click'""")
def q_followed_within(spark, d):
    def build(df):
        rows = df.withColumnRenamed("event_id", "id")
        return event_time.followed_within(rows.where("event_type = 'view'"), rows.where("event_type = 'click'"), "user_id", "2 hours", "1 hour")

    return chain.in_parts(timed(spark, d), "part", 2, build, "followed").select("user_id", "first_id", "then_id")


# --- phrases, slices, snapshots ------------------------------------------------------------------------------------------

#: Phrases: heads of the benchmark's passages and single words of theirs, in normal form.
_PHRASES = "SELECT DISTINCT lower(p) AS p FROM (SELECT unnest([substr(text, 1, 40), split_part(text, ' ', 2), split_part(text, ' ', 3) || ' ' || split_part(text, ' ', 4)]) AS p FROM benchmark) WHERE p <> ''"
_TEXTS = "SELECT doc_id, lower(text) AS t FROM documents WHERE text <> '' UNION ALL SELECT -1 - item_id, lower(split_part(text, ' ', 3)) FROM benchmark WHERE split_part(text, ' ', 3) <> ''"


def _phrases_and_texts(spark, d) -> tuple[DataFrame, DataFrame]:
    bench, docs = table(spark, d, "benchmark"), table(spark, d, "documents")
    word = lambda k: F.split_part("text", F.lit(" "), F.lit(k))
    phrases = bench.select(F.explode(F.array(F.substring("text", 1, 40), word(2), F.concat(word(3), F.lit(" "), word(4)))).alias("p")).select(F.lower("p").alias("p"))
    texts = docs.select(F.col("doc_id").alias("key"), F.lower("text").alias("text")).unionByName(bench.select((-1 - F.col("item_id")).alias("key"), F.lower(word(3)).alias("text")))
    return phrases, texts


@query(f"""WITH p AS ({_PHRASES}), t AS ({_TEXTS}) SELECT doc_id AS key, count(*) AS n, md5(string_agg(p, chr(10) ORDER BY p)) AS digest FROM t JOIN p ON contains(t, p) OR contains(p, t) GROUP BY ALL""")
def q_phrases_in_texts(spark, d):
    phrases, texts = _phrases_and_texts(spark, d)
    return _told(substrings.substring_pairs(texts, phrases))


@query(f"""WITH p AS ({_PHRASES}), t AS ({_TEXTS}) SELECT doc_id AS key, count(*) AS n, md5(string_agg(p, chr(10) ORDER BY p)) AS digest FROM t JOIN p ON contains(t, p) OR contains(p, t) GROUP BY ALL""")
def q_phrases_joined(spark, d):
    """The same where the phrases are too large for an index in every task."""
    phrases, texts = _phrases_and_texts(spark, d)
    return _told(substrings.substring_pairs(texts, phrases, index_bytes=0))


@query("""WITH p AS (SELECT DISTINCT unnest([split_part(text, ' ', 2), split_part(text, ' ', 3), split_part(text, ' ', 3) || ' ' || split_part(text, ' ', 4)]) AS p FROM benchmark),
r AS (SELECT string_agg(regexp_escape(p), '|' ORDER BY length(p) DESC, p) AS r FROM p WHERE p <> '') SELECT doc_id, md5(regexp_replace(text, '(' || r || ')', '<\\1>', 'g')) AS digest FROM documents, r""")
def q_converted_texts(spark, d):
    """Texts converted by a table of words and pairs of words, the longest at each place."""
    word = lambda k: F.split_part("text", F.lit(" "), F.lit(k))
    phrases = table(spark, d, "benchmark").select(F.explode(F.array(word(2), word(3), F.concat(word(3), F.lit(" "), word(4)))).alias("phrase"))
    change = conversion.longest_match(phrases.select("phrase", F.concat(F.lit("<"), "phrase", F.lit(">")).alias("replacement")))
    return table(spark, d, "documents").select("doc_id", F.md5(change("text")).alias("digest"))


def _told(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.md5(F.array_join(F.sort_array(F.collect_list("p")), "\n")).alias("digest"))


SLICES = slicing.SliceLimits(threshold=0.4, least=3, interval=3, kept=2)
_F = "(SELECT user_id, value / 40 AS x, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events)"


@query(f"""WITH f AS {_F}, n AS (SELECT user_id, count(*) AS n FROM f GROUP BY 1),
l AS (SELECT *, i - lag(i) OVER (PARTITION BY user_id ORDER BY i) AS gap FROM f WHERE abs(x) >= {SLICES.threshold}),
k AS (SELECT *, sum((gap IS NULL OR gap - 1 >= {SLICES.interval})::INT) OVER (PARTITION BY user_id ORDER BY i) AS k FROM l),
s AS (SELECT user_id, k, min(i) AS low, max(i) AS high FROM k GROUP BY 1, 2),
b AS (SELECT *, coalesce((low - lag(high) OVER w - 1) // 2, low) AS before, (lead(low) OVER w - high - 1) // 2 AS after FROM s WINDOW w AS (PARTITION BY user_id ORDER BY k)),
c AS (SELECT b.user_id, row_number() OVER (PARTITION BY b.user_id ORDER BY k) - 1 AS slice, low - least({SLICES.kept}, before) AS first, high + 1 + least({SLICES.kept}, coalesce(after, n - high - 1)) AS stop FROM b JOIN n USING (user_id) WHERE high - low + 1 >= {SLICES.least})
SELECT c.user_id, slice::INT AS slice, first::INT AS first, stop::INT AS stop, round({slicing.LEVEL!r} / greatest(1.0, max(abs(x))), 6) AS gain FROM c JOIN f ON f.user_id = c.user_id AND i >= first AND i < stop GROUP BY ALL""")
def q_recording_slices(spark, d):
    """A user's values as the frames of one recording, cut into many slices by the table function."""
    frames = table(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", (F.col("value") / 40).alias("x")))).alias("f"))
    frames = frames.select("user_id", F.transform("f", lambda r: r["x"]).alias("frames"))
    return slicing.slice_recordings(frames, limits=SLICES).withColumn("gain", F.round("gain", 6))


_CHANGED = "o_orderkey % 7 = 3 AND o_custkey % 64 < 9"


@query(f"""SELECT 'orders' AS name, o_orderstatus AS status, count(*) AS n, sum(o_orderkey)::BIGINT AS keys, round(sum(price), 2) AS total FROM (SELECT o_orderkey, CASE WHEN {_CHANGED} THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
CASE WHEN {_CHANGED} THEN o_totalprice + 1 ELSE o_totalprice END AS price FROM orders WHERE NOT ({_CHANGED} AND o_orderkey % 2 = 0) UNION ALL SELECT -1 - o_orderkey, 'N', o_totalprice FROM orders WHERE o_orderkey % 11 = 5) GROUP BY 2
UNION ALL SELECT 'before', o_orderstatus, count(*), sum(o_orderkey)::BIGINT, round(sum(o_totalprice), 2) FROM orders GROUP BY 2
UNION ALL SELECT 'changes', 'X', count(*), sum(o_orderkey)::BIGINT, 0.0 FROM orders WHERE {_CHANGED}""")
def q_snapshot_merge(spark, d):
    """Orders as a snapshot table: one commit makes them and an empty log, the next merges changes, inserts and deletions and fills the log; the version before stays readable."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").alias("price"))
    store = snapshots.Snapshots(spark, scratch.scratch_path(spark, "snapshots"), 16)
    log = orders.where(_CHANGED).select("o_orderkey")
    store.begin().replace("orders", orders, "o_orderkey").replace("changes", log.where("false"), "o_orderkey").publish()
    changes = orders.where(_CHANGED).withColumns({"o_orderstatus": F.lit("X"), "price": F.col("price") + 1, "gone": F.col("o_orderkey") % 2 == 0})
    added = orders.where("o_orderkey % 11 = 5").withColumns({"o_orderkey": -1 - F.col("o_orderkey"), "o_orderstatus": F.lit("N"), "gone": F.lit(False)})
    store.begin().merge("orders", changes.unionByName(added), "gone").replace("changes", log, "o_orderkey").publish()

    def told(rows: DataFrame, name: str) -> DataFrame:
        each = rows.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"), F.round(F.sum("price"), 2).alias("total"))
        return each.select(F.lit(name).alias("name"), "status", "n", "keys", "total")

    logged = store.read("changes").withColumns({"o_orderstatus": F.lit("X"), "price": F.lit(0.0)})
    return told(store.read("orders"), "orders").unionByName(told(store.read("orders", 1), "before")).unionByName(told(logged, "changes"))
