"""Conversation memory: which turns are archived, optimistic commits, context order; batch and streaming."""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from winnowry.config import CompactionLimits
from winnowry.functions.text import strip


def committed(messages: DataFrame) -> DataFrame:
    """Messages (session_id, turn, role, content) without a last user message that has no reply: a failed turn is rolled back."""
    order = Window.partitionBy("session_id").orderBy(F.desc("turn"))
    return messages.withColumn("_rn", F.row_number().over(order)).where(~((F.col("_rn") == 1) & (F.col("role") == "user"))).drop("_rn")


def plan_compaction(messages: DataFrame, limits: CompactionLimits | None = None) -> DataFrame:
    """(session_id, archived): how many leading messages are to be summarised, for sessions over a trigger. System messages aren't part of a session's turns."""
    c = limits or CompactionLimits()
    talk = messages.where(F.col("role").isin("user", "assistant"))
    each = talk.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("chars"), F.max_by("role", "turn").alias("last"))
    each = each.withColumn("turns", F.floor((F.col("n") - (F.col("last") == "user").cast("int")) / 2))
    due = each.where(((F.col("turns") >= c.trigger_turns) | (F.col("chars") >= c.trigger_chars)) & (F.col("turns") > c.recent_turns))
    return due.select("session_id", ((F.col("turns") - c.recent_turns) * 2).alias("archived"))


def archived_messages(messages: DataFrame, plan: DataFrame) -> DataFrame:
    """Messages with ``archived``: whether the plan covers them."""
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("turn"))
    talk = messages.where(F.col("role").isin("user", "assistant")).withColumn("_rn", place)
    return talk.join(plan, "session_id", "left").withColumn("archived", F.coalesce(F.col("_rn") <= F.col("archived"), F.lit(False))).drop("_rn")


def prefix_digest(messages: DataFrame) -> DataFrame:
    """(session_id, digest) of archived messages, by which a commit knows that the planned prefix still stands."""
    rows = messages.where("archived").groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "content"))).alias("m"))
    return rows.select("session_id", F.sha2(F.to_json("m"), 256).alias("digest"))


def normal_summary(text: Column, most: int = 1800) -> Column:
    return F.substring(strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " ")), 1, most)


def apply_compaction(messages: DataFrame, current: DataFrame, planned: DataFrame, summaries: DataFrame, limits: CompactionLimits | None = None) -> DataFrame:
    """messages with ``archived``; current (session_id, digest, summary); planned (session_id, digest, previous_summary); summaries (session_id, summary).
    Archived messages go where the summary says something and neither prefix nor earlier summary has changed since the plan."""
    c = limits or CompactionLimits()
    new = summaries.select("session_id", normal_summary(F.col("summary"), c.summary_chars).alias("new_summary")).where("new_summary <> ''")
    same = planned.join(current.withColumnRenamed("digest", "now"), "session_id").where(F.col("digest").eqNullSafe(F.col("now")) & F.coalesce("previous_summary", F.lit("")).eqNullSafe(F.coalesce("summary", F.lit(""))))
    done = same.select("session_id").join(new, "session_id")
    return messages.join(done, "session_id", "left").where(F.col("new_summary").isNull() | ~F.col("archived"))


def context(summaries: DataFrame, extra: DataFrame, recent: DataFrame) -> DataFrame:
    """(session_id, messages): summary, facts and examples, then recent messages, in that order. summaries and extra: session_id, content; recent: session_id, turn, role, content."""
    part = lambda rows, k, role, turn: rows.select("session_id", F.lit(k).alias("k"), turn.cast("long").alias("turn"), role.alias("role"), "content")
    rows = part(extra, 0, F.lit("system"), F.lit(0)).unionByName(part(summaries, 1, F.lit("system"), F.lit(0))).unionByName(part(recent, 2, F.col("role"), F.col("turn")))
    each = rows.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("k", "turn", "role", "content"))).alias("m"))
    return each.select("session_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def summary_prompt(messages: DataFrame) -> DataFrame:
    """(session_id, system, dialogue): system rows joined by blank lines; user and assistant rows as lines, in order."""
    rows = messages.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "content"))).alias("m"))
    of = lambda keep: F.transform(F.filter("m", keep), lambda x: F.when(x["role"] == "system", x["content"]).otherwise(F.concat(x["role"], F.lit(": "), x["content"])))
    return rows.select("session_id", F.array_join(of(lambda x: x["role"] == "system"), "\n\n").alias("system"), F.array_join(of(lambda x: x["role"].isin("user", "assistant")), "\n").alias("dialogue"))


def event_order(events: DataFrame) -> DataFrame:
    """Events (session_id, turn, index, type, ...) with ``place``: sentence k + 1 comes after the audio of sentence k; done and error come last."""
    kind = F.when(F.col("type") == "sentence", 0).when(F.col("type").isin("audio", "audio_error"), 1).otherwise(2)
    last = kind == 2
    order = Window.partitionBy("session_id", "turn").orderBy(last, F.coalesce("index", F.lit(0)), kind)
    return events.withColumn("place", F.row_number().over(order))


def fold_events(events: DataFrame) -> DataFrame:
    """(session_id, turn, text, n_audio, n_failed, state): messages as a client shows them."""
    each = events.groupBy("session_id", "turn").agg(
        F.sort_array(F.collect_list(F.when(F.col("type") == "sentence", F.struct("index", "text")))).alias("s"), F.count_if(F.col("type") == "audio").alias("n_audio"),
        F.count_if(F.col("type") == "audio_error").alias("n_failed"), F.when(F.bool_or(F.col("type") == "error"), "error").when(F.bool_or(F.col("type") == "done"), "done").otherwise("open").alias("state"),
    )
    return each.select("session_id", "turn", F.array_join("s.text", "").alias("text"), "n_audio", "n_failed", "state")


def audio_queue(events: DataFrame) -> DataFrame:
    """Audio events, each key once; also over a stream."""
    return events.where("type = 'audio'").dropDuplicates(["session_id", "turn", "index"])


def newest_audio(events: DataFrame) -> DataFrame:
    return audio_queue(events).groupBy("session_id").agg(F.max_by(F.struct("turn", "index"), F.struct("turn", "index")).alias("play"))


def stream_sessions(messages: DataFrame, limits: CompactionLimits | None = None, ttl_minutes: int | None = 120) -> DataFrame:
    """A stream of committed messages (session_id, turn, role, content) -> (session_id, archived, kept): for each batch of a session, how
    many messages it now archives and keeps. State holds the kept messages' lengths only. Idle sessions are evicted after
    ``ttl_minutes``; give None to a run that ends when its input does, which a timeout by the clock would keep going."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    c = limits or CompactionLimits()

    def go(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(state.get[0]) if state.exists else []
        new = pd.concat(list(frames))
        new = new[new["role"].isin(["user", "assistant"])].sort_values("turn", kind="stable")
        kept += [len(x or "") * 2 + (r == "user") for x, r in zip(new["content"], new["role"], strict=True)]
        turns = (len(kept) - (kept[-1] & 1 if kept else 0)) // 2
        archived = 0
        if (turns >= c.trigger_turns or sum(k >> 1 for k in kept) >= c.trigger_chars) and turns > c.recent_turns:
            archived = 2 * (turns - c.recent_turns)
            kept = kept[archived:]
        state.update((kept,))
        if ttl_minutes is not None:
            state.setTimeoutDuration(ttl_minutes * 60_000)
        yield pd.DataFrame({"session_id": [key[0]], "archived": [archived], "kept": [len(kept)]})

    return messages.groupBy("session_id").applyInPandasWithState(go, "session_id string, archived int, kept int", "kept array<int>", "append", GroupStateTimeout.NoTimeout if ttl_minutes is None else GroupStateTimeout.ProcessingTimeTimeout)


def to_evict(sessions: DataFrame, most: int) -> DataFrame:
    """Sessions (session_id, last_used, reservations, locked) that go so that ``most`` stay: the longest unused that nobody holds. Busy ones stay, even above the limit."""
    over = max(0, sessions.count() - most)
    idle = sessions.where((F.coalesce("reservations", F.lit(0)) == 0) & ~F.coalesce("locked", F.lit(False)))
    return idle.orderBy("last_used", "session_id").limit(over).select("session_id")


def windowed_counts(events: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Event-time counts per window and type, with a watermark (an addition of this engine; batch and stream)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
