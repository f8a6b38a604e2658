"""Document fingerprints: bottom-k sketches of word shingle hashes, in DataFrame functions only.

A sketch is the ascending array of the ``k`` smallest distinct hashes of a text's shingles. Sketches of parts merge into
the sketch of the whole, and estimate resemblance, containment and the number of distinct shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from saccade.llm.common import id_and_text, parallelism
from saccade.session import cut_lineage

K = 128
SHINGLE = 5


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """Hashes of each run of ``size`` lower-cased words; of all words where there are fewer; none for no words."""
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    # An array is bound once, so that it is not built anew for every shingle.
    return F.flatten(F.transform(F.array(hashed), lambda h: F.when(
        F.size(h) >= size, F.transform(F.sequence(F.lit(1), F.greatest(F.size(h) - (size - 1), F.lit(1))), lambda i: F.xxhash64(
            *[F.element_at(h, (i + k).cast("int")) for k in range(size)])))
        .when(F.size(h) > 0, F.array(F.xxhash64(F.concat_ws(" ", h.cast("array<string>"))))).otherwise(F.array().cast("array<bigint>"))))


def sketch(text: Column, k: int = K, size: int = SHINGLE) -> Column:
    return bottom(shingle_hashes(text, size), k)


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge_sketches(parts: DataFrame, key: str, column: str, k: int = K) -> DataFrame:
    """The sketch of all parts with one key. Hashes are made distinct before they are ranked, at most ``k`` of each part."""
    hashes = parts.select(key, F.explode_outer(column).alias("h")).distinct()
    ranked = hashes.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.asc_nulls_last("h"))))
    return ranked.where(F.col("r") <= k).groupBy(key).agg(F.sort_array(F.collect_list("h")).alias(column))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Share of common shingles among all of both texts, 1 for two texts without words."""
    return F.element_at(F.transform(F.array(F.struct(bottom(F.concat(a, b), k).alias("u"), F.array_intersect(a, b).alias("i"))), lambda s: F.when(
        F.size(s["u"]) == 0, 1.0).otherwise(F.size(F.array_intersect(s["u"], s["i"])) / F.size(s["u"]))), 1)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Number of distinct shingles: exact below ``k``, else from the place of the k-th hash in the range of hashes."""
    top = (F.element_at(a, -1).cast("double") + float(2**63)) / float(2**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / top)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Share of the shingles of ``a`` that ``b`` has too, from the resemblance and both sizes."""
    j, n, m = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), j / (1 + j) * (n + m) / n))


def as_text(a: Column) -> Column:
    """A sketch as text: its hashes in hexadecimal, in base 64."""
    joined = F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")
    return F.translate(F.base64(F.unhex(joined)), "\r\n", "")


def next_ids(rows: DataFrame) -> DataFrame:
    """Every distinct row of ``rows`` (doc_id, mark and what they decide) with the ``next`` key in descending order, null ids
    last; after the last the first.

    Keys are cut into ranges; within a range the next key is the next row, and between ranges only the ends of each range
    meet, which are as few as the partitions."""
    n = parallelism(rows.sparkSession)
    order = [F.desc_nulls_last("doc_id"), F.col("mark")]
    ranged = cut_lineage(rows.distinct().repartitionByRange(n, *order).withColumn("range", F.spark_partition_id()))
    inside = Window.partitionBy("range").orderBy(*order)
    first = F.row_number().over(inside) == 1
    ahead = ranged.select("*", F.lead(F.struct("doc_id", "mark")).over(inside).alias("following"), first.alias("is_first"))
    heads = ahead.where("is_first").select("range", F.struct("doc_id", "mark").alias("head"))
    ends = Window.orderBy("range")
    everything = ends.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = heads.select("range", F.coalesce(F.lead("head").over(ends), F.first("head").over(everything)).alias("after"))
    return ahead.join(F.broadcast(after), "range").select(*rows.columns, F.coalesce("following", "after").alias("next"))


def with_next(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, text, the edited text and the sketch ``other`` of the next document.

    An edited text is the text with its last third (rounded down, in code points) replaced by as many code points from
    the start of the next document in descending order of id. Rows equal in id and text share a next document; a lone
    document is its own. Only a sketch and the part of a text that is put in travel to the text they are for, and both
    joins read one shuffle of the texts."""
    # Keys without nulls: a plain equality lets the grouping below and the join after it share one shuffle.
    texts = id_and_text(docs).withColumn("mark", F.xxhash64("text")).withColumn("id_key", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    third = F.floor(F.length("text") / 3).cast("int")
    asked = next_ids(texts.select("doc_id", "mark", third.alias("need"))).select(
        F.col("doc_id").alias("own_id"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("for_id"), F.col("mark").alias("for_mark"),
        F.coalesce(F.col("next.doc_id").cast("string"), F.lit("")).alias("next_id"), F.col("next.mark").alias("next_mark"), "need")
    given = texts.join(asked, (F.col("id_key") == F.col("next_id")) & (F.col("mark") == F.col("next_mark"))).select(
        "own_id", "for_id", "for_mark", F.expr("substring(text, 1, need)").alias("put"), sketch(F.col("text"), k).alias("other"))
    # A next document that is repeated gives its part several times.
    given = given.groupBy("for_id", "for_mark").agg(
        F.first("own_id").alias("own_id"), F.first("put").alias("put"), F.first("other").alias("other"))
    rows = texts.join(given, (F.col("id_key") == F.col("for_id")) & (F.col("mark") == F.col("for_mark")))
    kept = F.expr("left(text, length(text) - cast(floor(length(text) / 3) as int))")
    return rows.select(F.col("own_id").alias("doc_id"), "text", F.concat(kept, F.col("put")).alias("edited"), "other")


def document_fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """Sketches of every text and its edited text, and how alike the two are and the text and the next document.

    A null text is empty: its sketch is empty, which is wholly like another empty one and not at all like others. Repeated
    rows are repeated in the result. An empty table gives no rows."""
    met = with_next(docs, k).select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        sketch(F.col("text"), k).alias("own"), sketch(F.col("edited"), k).alias("changed"), "other")
    return met.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("changed")).alias("edited_fingerprint"),
        resemblance(F.col("own"), F.col("changed"), k).alias("near_edited"),
        resemblance(F.col("own"), F.col("other"), k).alias("near_next"),
        containment(F.col("own"), F.col("changed"), k).alias("contained_in_edited"),
        distinct_shingles(F.col("own"), k).alias("distinct_shingles"))
