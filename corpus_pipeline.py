"""The corpus pipeline: five stages over ``documents``, each by one of the training-data operators.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and its decisions take effect. All but the
last return the columns of ``documents``; the last returns the packed pieces.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from winnowry.llm import langid, line_dedup, minhash_dedup, mixing, packing
from winnowry.llm._store import staged
from winnowry.llm.queries import TOKENIZER, remainder, table

#: A document goes if no language has this share of its words' posteriors, or if it has no letter.
LEAST_LANGUAGE_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go: null, empty and letterless texts, and those of which no language has the least score.
    Where no language can be learned, texts with letters stay. Repeated rows are judged alike; other columns are carried along."""
    return langid.keep_known(docs, langid.fit(docs, remainder(4) != 2), LEAST_LANGUAGE_SCORE)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines go that an earlier line (by document id and line number) equals or nearly equals; lines without words stay, and documents all of whose lines
    go stay with an empty text. Null texts stay null; rows that repeat an id lose the same lines; rows without id stay whole."""
    return line_dedup.drop_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document stays, the one with the smallest id (null ids last), once also where rows repeat. Documents without words all stay."""
    return minhash_dedup.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out or repeated so that sources have their target weights; a null source is the source ''. Documents without tokens are kept once."""
    return mixing.realise(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as pieces in sequences of 2048 tokens; a null or empty text is one piece of one token, and repeated rows are packed as often as they come."""
    return packing.best_fit_pack(docs, TOKENIZER)


STAGES = [("language_id", language_id), ("dedup_lines", dedup_lines), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("pack", pack)]
#: The stages are models, joins on shingles and token ids, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
