"""The queries of the text operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saccade.llm import divergence, exact, lines, merges, mixture, packing, permutations, simhash, sketches, streams, substrings, toxicity, tries
from saccade.llm.common import read_table
from saccade.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function
    return register


@query("op3_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


@query("op4_exact_dedup", r"""
    WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce("text", ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
    SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
    FROM t WINDOW g AS (PARTITION BY text_sha256)""")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(read_table(spark, sf_dir, "documents"))


@query("op6_simhash_dedup")
def simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(read_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op7_arrow_streams")
def arrow_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = read_table(spark, sf_dir, "documents"), scratch_path(spark, "streams")
    manifest = streams.write_streams(docs, folder, public_tokenizers.path("byte_bpe_50k.json"))
    return streams.read_documents(manifest, folder, docs.schema["doc_id"].dataType.simpleString())


@query("op8_byte_bpe")
def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = merges.encode(read_table(spark, sf_dir, "documents"), ranks)
    return merges.decode(encoded, ranks).drop("decoded")


@query("op2_document_fingerprints")
def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.document_fingerprints(read_table(spark, sf_dir, "documents"))


@query("op5_toxicity")
def document_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.document_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query("op9_language_mixture")
def language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.identify(read_table(spark, sf_dir, "documents"))


@query("op10_line_quality")
def line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.document_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query("op1_suffix_dedup", """
    WITH t AS (SELECT doc_id, hex(encode(coalesce("text", ''))) AS h FROM documents),
    w AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 800)) AS m
          FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 399)) AS p FROM t)),
    r AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY m) AS n FROM w) WHERE n > 1),
    g AS (SELECT doc_id, p, p > 400 + coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p), -1000) AS opens FROM r),
    s AS (SELECT doc_id, sum(opens::int) OVER (PARTITION BY doc_id ORDER BY p) AS k, p FROM g),
    c AS (SELECT doc_id, k, min(p) AS a, max(p) + 400 AS b FROM s GROUP BY ALL),
    e AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS f FROM c),
    o AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS z,
                 string_agg(substr(h, 2 * f + 1, 2 * (a - f)), '' ORDER BY a) AS kept FROM e JOIN t USING (doc_id) GROUP BY doc_id)
    SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::bigint AS n_removed, coalesce(n_spans, 0) AS n_spans,
           sha256(unhex(coalesce(kept || substr(h, 2 * z + 1), h))) AS kept_sha256, try(decode(unhex(coalesce(kept || substr(h, 2 * z + 1), h)))) AS "text"
    FROM t LEFT JOIN o USING (doc_id)""")
def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_spans(read_table(spark, sf_dir, "documents")).drop("spans")


@query("op13_source_divergence", r"""
    WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce("source", '') AS source,
                      translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    w AS (SELECT k, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    terms AS (SELECT lang, term, count(*) AS total FROM w GROUP BY ALL HAVING count(DISTINCT k) >= 30),
    n AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN terms USING (lang, term) GROUP BY ALL),
    v AS (SELECT lang, count(*) AS kinds, sum(total) AS lang_sum FROM terms GROUP BY lang),
    g AS (SELECT DISTINCT lang, source FROM d),
    s AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN n USING (lang, source) GROUP BY ALL),
    p AS (SELECT s.lang, s.source, term, coalesce(n, 0) AS n,
                 (1 + 1000000000::hugeint * (coalesce(n, 0) + 5) // (s.total + 5 * kinds)::hugeint)::bigint AS p,
                 (1 + 1000000000::hugeint * (terms.total + 5) // (lang_sum + 5 * kinds)::hugeint)::bigint AS q
          FROM s JOIN v USING (lang) JOIN terms USING (lang) LEFT JOIN n USING (lang, source, term)),
    pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::bigint AS value
              FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
              LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value
                         FROM p x JOIN p y USING (lang, term) GROUP BY ALL) z
              ON z.lang = a.lang AND z.source = a.source AND z.item = b.source),
    r AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs
          UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
    SELECT lang, source, part, item, value, rank::int AS rank
    FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
    WHERE part = 'pair' OR rank <= 50""")
def source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(read_table(spark, sf_dir, "documents"))


@query("op11_conversation_trie", """
    WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce("text", '') AS body, row_number() OVER (
                   PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce("text", ''))) AS pos
               FROM conversations WHERE conv_id IS NOT NULL),
    ids AS (SELECT DISTINCT conv_id, conv_id - conv_id % 5 AS base_id, conv_id::varchar AS d FROM t),
    x AS (SELECT conv_id, base_id, list_reduce(list_prepend(4294967295::bigint, range(8 * length(d))::bigint[]), lambda v, s:
              xor(xor(v, CASE WHEN s % 8 = 0 THEN ord(d[(s // 8 + 1)::int]) ELSE 0 END) >> 1,
                  CASE WHEN xor(v, CASE WHEN s % 8 = 0 THEN ord(d[(s // 8 + 1)::int]) ELSE 0 END) % 2 = 1 THEN 3988292384 ELSE 0 END)) AS v FROM ids),
    c AS (SELECT conv_id, base_id, xor(v, 4294967295) % 9 AS h FROM x),
    r AS (SELECT c.conv_id, 0 AS own, t.pos, role, body FROM c JOIN t ON t.conv_id = c.base_id AND t.pos <= h
          UNION ALL SELECT c.conv_id, 1, t.pos, role, body FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > h),
    s AS (SELECT conv_id, row_number() OVER w AS depth, body, list({'role': role, 'body': body}) OVER w AS path FROM r
          WINDOW w AS (PARTITION BY conv_id ORDER BY own, pos)),
    m AS (SELECT conv_id, depth, strlen(body) AS size, path FROM s
          UNION ALL SELECT conv_id, 0, 0, []::struct(role varchar, body varchar)[] FROM ids),
    l AS (SELECT conv_id, max(depth) AS turns FROM m GROUP BY conv_id),
    n AS (SELECT path, min(conv_id) AS conv_id, depth, count(*) AS n_convs, max(size) AS size, path[:(depth - 1)::int] AS up,
                 coalesce(string_agg(conv_id::varchar, ',' ORDER BY conv_id) FILTER (depth = turns), '') AS ends
          FROM m JOIN l USING (conv_id) GROUP BY path, depth),
    k AS (SELECT up AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY up),
    f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (path)),
    b AS (SELECT a.path, count(*) FILTER (x.n_children = 0) AS n_leaves, sum((x.n_convs - 1) * x.size)::bigint AS saved_tokens
          FROM f a JOIN f x ON x.depth >= a.depth AND x.path[:a.depth::int] = a.path GROUP BY a.path)
    SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, sha256(f.ends) AS ends_sha256
    FROM f JOIN b USING (path) LEFT JOIN n p ON p.path = f.up AND f.depth > 0""")
def conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.conversation_trie(read_table(spark, sf_dir, "conversations"))


@query("op12_permutation_index")
def permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutations.nearest_vectors(read_table(spark, sf_dir, "embeddings"))
