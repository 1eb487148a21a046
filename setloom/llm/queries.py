"""The subpackage's queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from setloom.llm.chat_events import ORACLE as CHAT_SQL
from setloom.llm.chat_events import REPLAY_ORACLE, chats, replayed_log, turns_as_events
from setloom.llm.decontaminate import leaks
from setloom.llm.graph_ann import neighbours
from setloom.llm.hilbert import oracle_sql as shard_sql
from setloom.llm.hilbert import shards
from setloom.llm.language_id import identify, prototypes
from setloom.llm.lbl_lm import lm_scores
from setloom.llm.mixing import mixed
from setloom.llm.near_dup import near_duplicates
from setloom.llm.quality_pu import score_quality, train
from setloom.llm.token_prefix import token_prefixes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, prototypes(docs))


def op3_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, train(docs, table(spark, sf_dir, "labels"), toxic_col="toxic"))


def op7_token_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_prefixes(table(spark, sf_dir, "documents"))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats(turns_as_events(table(spark, sf_dir, "conversations")))


def chat_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ninth operator over a log of deltas, edits, regenerations and deletions that is made of the conversations."""
    return chats(replayed_log(table(spark, sf_dir, "conversations")))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_near_duplicates, op2_language_id, op3_hilbert_shards, op4_mixing, op5_lm_scores, op6_quality, op7_token_prefixes, op8_neighbours, op9_chat_format, op10_decontamination, chat_replay]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_hilbert_shards": shard_sql(), "op9_chat_format": CHAT_SQL, "chat_replay": REPLAY_ORACLE}
