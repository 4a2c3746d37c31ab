"""Streams put together: files as they come, tokens to sentences to speech, and runs that end with their input."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnowry.sources import scratch
from winnowry.streaming.sentences import stream_sentences
from winnowry.streaming.stateful import state_store

EVENTS = "session_id string, turn long, index int, type string, text string, audio string"


def poll(spark: SparkSession, path: str, ddl: str, form: str = "json", files_per_batch: int = 1000) -> DataFrame:
    """A stream over the files of a folder, each read once as it appears whole; an upstream step commits its files there when it's done."""
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", files_per_batch).format(form).load(path)


def run_available(stream: DataFrame, path: str, checkpoint: str, form: str = "parquet", mode: str = "append") -> None:
    """Process what is there and end; the checkpoint remembers it, so the next run takes what came since."""
    stream.writeStream.format(form).outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def in_parts(rows: DataFrame, part: str, parts: int, build: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """What a stream gives for rows that arrive part by part (column ``part``, from 0). The stream is stopped after each part and goes on from its checkpoint
    with the next, in the folder that executors share; the last part's end leaves what still waits unsaid."""
    spark = rows.sparkSession
    source, out, checkpoint = (scratch.scratch_path(spark, f"{name}_{x}") for x in ("in", "out", "at"))
    schema = rows.drop(part).schema
    with state_store(spark):
        for k in range(parts):
            rows.where(F.col(part) == k).drop(part).write.mode("append").parquet(source)
            run_available(build(spark.readStream.schema(schema).parquet(source)), out, checkpoint)
    return spark.read.parquet(out)


def speech_events(sentences: DataFrame, synthesise: Callable[[pd.Series], list[str | None]]) -> DataFrame:
    """Sentences (session_id, turn, number, sentence) to events: each sentence, then its audio, or audio_error where the call gives none. A batch
    of sentences is one call; where that fails, each is called for alone, and what fails then is an error of its sentence only, whose text says why."""

    def alone(sentence: str) -> tuple[str | None, str | None]:
        try:
            return list(synthesise(pd.Series([sentence])))[0], None
        except Exception as error:
            return None, f"{type(error).__name__}: {error}"

    def go(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if pdf.empty:
                continue
            try:
                audio, why = list(synthesise(pdf["sentence"])), [None] * len(pdf)
            except Exception:
                audio, why = zip(*map(alone, pdf["sentence"]), strict=True)
            said = pd.DataFrame({"session_id": pdf["session_id"], "turn": pdf["turn"], "index": pdf["number"], "type": "sentence", "text": pdf["sentence"], "audio": None})
            heard = said.assign(type=["audio" if a else "audio_error" for a in audio], text=why, audio=audio)
            yield pd.concat([said, heard]).sort_index(kind="stable")

    return sentences.select("session_id", "turn", "number", "sentence").mapInPandas(go, EVENTS)


def speak(tokens: DataFrame, synthesise: Callable[[pd.Series], list[str | None]], **limits) -> DataFrame:
    """The chain of a turn: a stream of tokens to sentences to events."""
    return speech_events(stream_sentences(tokens, **limits), synthesise)
