"""Collapse threaded messages into one record per conversation.

Aggregation runs in two levels so that no task sorts or buffers a whole hot
conversation: turns are numbered with ``ordinal_within`` (chunked), partial
strings are built per (conversation, chunk of turns), and the final step joins
the already ordered chunk strings. Counts are plain partial aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.functions.rules import SUPPORT_AUTHOR
from threadlens.functions.frames import keep_rows
from threadlens.functions.text import clean_ascii
from threadlens.operators.ordering import CHUNK_ROWS, ordinal_within
from threadlens.session import cut_lineage

RECORD_COLUMNS = ["conversation_id", "text", "transcript", "customer_turns", "support_turns",
                  "n_messages", "n_customer_turns", "n_support_turns"]


def _join_nonempty(arr_col, sep=" "):
    return F.array_join(F.filter(arr_col, lambda s: F.length(s) > 0), sep)


def build_records(threaded: DataFrame, support_author: str = SUPPORT_AUTHOR, drop_roles=None,
                  chunk_width: int = 4096, unescape: str = "full") -> DataFrame:
    """D1-D3 over (conversation_id, thread_order, author_id, text).

    Turns are cleaned with B1 and empty results dropped before numbering, so
    the transcript numbering never skips. Role: the support account -> support,
    everyone else -> customer. Keeps conversations with >= 2 turns, >= 1
    support and >= 1 customer turn. ``drop_roles`` removes authors first (the
    driver's system turns).
    """
    # everyone who is not the support account is a customer, also an unknown author
    m = threaded.filter(F.col("conversation_id").isNotNull()).withColumn("author_id", F.coalesce("author_id", F.lit("")))
    if drop_roles:
        m = m.filter(~F.lower(F.col("author_id")).isin([r.lower() for r in drop_roles]))
    m = (m.select("conversation_id", F.col("thread_order").cast("long").alias("ord"),
                  F.lower(F.trim(F.col("author_id"))).alias("_author"), clean_ascii("text", unescape).alias("clean")))
    m = keep_rows(m, F.length("clean") > 0).withColumn("is_support", F.col("_author") == support_author.lower())
    # the cleaned turns feed two branches (chunk sizes and numbering):
    # materialise them instead of running the regex chain twice
    m = cut_lineage(m.drop("_author"))
    m = ordinal_within(m, "conversation_id", "ord", "pos", chunk_width if chunk_width < 4096 else CHUNK_ROWS)
    m = m.withColumn("_chunk", F.floor((F.col("pos") - 1) / F.lit(chunk_width)))

    turn = F.struct("pos", "is_support", "clean")
    part = (m.groupBy("conversation_id", "_chunk")
            .agg(F.array_sort(F.collect_list(turn)).alias("t"),
                 F.count(F.lit(1)).alias("n"),
                 F.count_if("is_support").alias("ns"))
            .select("conversation_id", "_chunk", "n", "ns",
                    F.array_join(F.transform("t", lambda x: x["clean"]), " ").alias("p_text"),
                    F.array_join(F.transform("t", lambda x: F.concat(F.lit("["), x["pos"].cast("string"),
                                                                     F.lit("] "), x["clean"])), " ").alias("p_tr"),
                    F.array_join(F.transform(F.filter("t", lambda x: ~x["is_support"]), lambda x: x["clean"]),
                                 " ").alias("p_cust"),
                    F.array_join(F.transform(F.filter("t", lambda x: x["is_support"]), lambda x: x["clean"]),
                                 " ").alias("p_supp")))
    piece = F.struct("_chunk", "p_text", "p_tr", "p_cust", "p_supp")
    rec = (part.groupBy("conversation_id")
           .agg(F.array_sort(F.collect_list(piece)).alias("c"),
                F.sum("n").cast("int").alias("n_messages"),
                F.sum("ns").cast("int").alias("n_support_turns"))
           .withColumn("n_customer_turns", (F.col("n_messages") - F.col("n_support_turns")).cast("int"))
           .filter((F.col("n_messages") >= 2) & (F.col("n_support_turns") >= 1) & (F.col("n_customer_turns") >= 1)))
    return rec.select(
        F.col("conversation_id").cast("long").alias("conversation_id"),
        _join_nonempty(F.transform("c", lambda x: x["p_text"])).alias("text"),
        _join_nonempty(F.transform("c", lambda x: x["p_tr"])).alias("transcript"),
        _join_nonempty(F.transform("c", lambda x: x["p_cust"])).alias("customer_turns"),
        _join_nonempty(F.transform("c", lambda x: x["p_supp"])).alias("support_turns"),
        "n_messages", "n_customer_turns", "n_support_turns")


def threaded_from_conversations(conversations: DataFrame) -> DataFrame:
    """The driver's ``conversations`` as threaded messages: conversation_id =
    conv_id, thread_order = turn + 1, author = role ('assistant' is support)."""
    return conversations.select(
        F.col("conv_id").alias("conversation_id"), (F.col("turn") + 1).alias("thread_order"),
        F.col("role").alias("author_id"), F.col("text"))


def first_n_by_id(records: DataFrame, n: int) -> DataFrame:
    """The first n records by conversation id (a top-n: Spark keeps a
    bounded heap per partition before the single merge)."""
    return records.orderBy("conversation_id").limit(n)


def seeded_sample(records: DataFrame, n: int, seed: int = 42, id_col: str = "conversation_id") -> DataFrame:
    """A reproducible sample of n rows: order by md5(seed-id), take n.
    Same rows in any engine that has md5 (Spark, DuckDB)."""
    key = F.md5(F.concat(F.lit(f"{seed}-"), F.col(id_col).cast("string")))
    return records.withColumn("_k", key).orderBy("_k", id_col).limit(n).drop("_k")
