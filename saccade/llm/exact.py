"""Exact de-duplication with a heavy-hitter split.

Misra-Gries summaries find digests that may be frequent; an exact count verifies them, and the few that hold (at most
``counters``) are broadcast, so that their copies are settled where they lie. Only the other digests are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from saccade.llm.common import id_and_text, unused
from saccade.session import cut_lineage

#: Counters of a summary. Bounds the broadcast. A digest that holds over 1 / COUNTERS of the rows is found but where other digests'
#: counts of single partitions push it out; it is then shuffled like any other, with the same result.
COUNTERS = 1000


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text_sha256 of the text in which each run of white space is one space; a null text is empty."""
    plain = F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")
    return id_and_text(docs, id_col, text_col).select("doc_id", F.sha2(plain, 256).alias("text_sha256"))


def misra_gries(pdfs: Iterator[pd.DataFrame], counters: int) -> Iterator[pd.DataFrame]:
    """The summary of a partition: at most ``counters`` digests with lower bounds of their counts."""
    held: dict[str, int] = {}
    for pdf in pdfs:
        for digest, n in pdf["text_sha256"].value_counts(sort=False).items():
            held[digest] = held.get(digest, 0) + int(n)
        if len(held) > counters:
            cut = sorted(held.values(), reverse=True)[counters]
            held = {k: v - cut for k, v in held.items() if v > cut}
    yield pd.DataFrame({"text_sha256": list(held), "n": list(held.values())}).astype({"text_sha256": str, "n": "int64"})


def frequent(hashed: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Digests that hold more than 1 / ``counters`` of the rows (and so fewer than ``counters``), with exact figures."""
    summaries = hashed.select("text_sha256").mapInPandas(
        lambda pdfs: misra_gries(pdfs, counters), "text_sha256 string, n long")
    candidates = summaries.groupBy("text_sha256").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "text_sha256").limit(counters)
    total = hashed.count()
    exact = (hashed.join(F.broadcast(candidates.select("text_sha256")), "text_sha256")
             .groupBy("text_sha256").agg(F.count("*").alias("hot_size"), F.min("doc_id").alias("hot_id")))
    return exact.where((F.col("hot_size") * counters > total) & (F.col("hot_size") > 1))


def duplicate_groups(hashed: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """One row per row of ``hashed`` (doc_id, text_sha256): keep_id, group_size and whether the row stays.

    The smallest doc_id of a group stays, null last; of rows that repeat it exactly one does."""
    winners = frequent(hashed, counters)
    marked = hashed.join(F.broadcast(winners), "text_sha256", "left")
    lost = F.col("hot_size").isNotNull() & (F.col("doc_id").isNull() & F.col("hot_id").isNotNull() | (F.col("doc_id") > F.col("hot_id")))
    settled = marked.where(lost).select("doc_id", F.col("hot_id").alias("keep_id"), F.col("hot_size").alias("group_size"),
                                        F.lit(False).alias("kept"), "text_sha256")
    group = Window.partitionBy("text_sha256")
    rest = marked.where(~F.coalesce(lost, F.lit(False))).select(
        "doc_id", F.min("doc_id").over(group).alias("keep_id"),
        F.coalesce("hot_size", F.count("*").over(group)).alias("group_size"),
        (F.row_number().over(group.orderBy(F.asc_nulls_last("doc_id"))) == 1).alias("kept"), "text_sha256")
    return settled.unionByName(rest)


def exact_groups(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Groups of equal normalised texts of ``docs``, as ``duplicate_groups``. An empty table gives no rows."""
    return duplicate_groups(cut_lineage(digests(docs)), counters)


def drop_exact_copies(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Rows equal in id and normalised text count as repeats."""
    keyed = digests(docs)
    groups = duplicate_groups(cut_lineage(keyed), counters)
    plain = F.regexp_replace(F.coalesce(docs["text"].cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")
    sha, stay_id, stay_sha, stays, n = unused(docs, "_row_sha", "_stay_id", "_stay_sha", "_stay", "_stay_rows")
    stay = groups.groupBy(F.col("doc_id").alias(stay_id), F.col("text_sha256").alias(stay_sha)).agg(
        F.max("kept").alias(stays), F.count("*").alias(n)).where(F.col(stays))
    rows = docs.withColumn(sha, F.sha2(plain, 256)).join(
        stay, F.col("doc_id").eqNullSafe(F.col(stay_id)) & (F.col(sha) == F.col(stay_sha)))
    repeated = rows.where(F.col(n) > 1).dropDuplicates([stay_id, stay_sha])
    return rows.where(F.col(n) == 1).unionByName(repeated).select(*[F.col(f"`{c}`") for c in docs.columns])
