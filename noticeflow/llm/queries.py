"""Queries of the training-data operators and, where SQL can express them, their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import block_naming, byte_bpe, byte_cnn, divergence, lexical_search, licenses, mixing, secrets, sharding, simhash, tile_cosine, token_store, warc
from .common import read


def op10_block_naming(spark, sf_dir):
    return block_naming.exact_dedup(read(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), k AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM n
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept,
       sha256(norm) AS text_sha256
FROM k
"""

def op1_secrets(spark, sf_dir):
    return secrets.digest(secrets.scan(read(spark, sf_dir, "documents")), "doc_id")


def op2_warc(spark, sf_dir):
    return warc.digest(warc.checked_round_trip(read(spark, sf_dir, "pages")))


OP2_SQL = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS bytes, sha1(coalesce(html, '')) AS hex,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS low
  FROM pages
), b AS (
  SELECT *, list_aggregate(list_transform(string_split(hex, ''),
           lambda c: lpad(bin(strpos('0123456789abcdef', c) - 1), 4, '0')), 'string_agg', '') AS bits
  FROM p
)
SELECT page_id, CAST(bytes AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + list_sum(list_transform(range(5), lambda k: CAST(substr(bits, 5 * i + k + 1, 1) AS INTEGER) << (4 - k)))::INTEGER, 1)),
         'string_agg', '') AS payload_digest,
       CASE WHEN page_id = low THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = low THEN NULL ELSE low END AS refers_to
FROM b
"""


def warc_salvage(spark, sf_dir):
    return warc.salvaged(read(spark, sf_dir, "pages"), F.col("page_id") % 17 == 0)


SALVAGE_SQL = """SELECT page_id, CASE WHEN page_id % 17 = 0 THEN 'quarantined' ELSE 'recovered' END AS outcome,
  CASE WHEN page_id % 17 = 0 THEN 'member does not unpack' END AS reason, CASE WHEN page_id % 17 <> 0 THEN true END AS intact FROM pages"""


def op3_simhash(spark, sf_dir):
    return simhash.near_dedup(read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id", "kept")


def op4_byte_bpe(spark, sf_dir):
    tokens = byte_bpe.round_trip(read(spark, sf_dir, "documents").select("doc_id", "text"), *default_vocabulary())
    return byte_bpe.digest(tokens, "doc_id")


def op5_sharding(spark, sf_dir):
    # files' names, sizes and the number of rounds differ from run to run; three appends come before the first merge
    rows = sharding.stored(read(spark, sf_dir, "documents"))
    return rows.withColumn("merged", F.col("manifest_version") > len(sharding.ARRIVALS)).drop("shard", "tier", "manifest_version")


#: All rows, no run that is still to merge, and more versions than appends.
OP5_SQL = "SELECT doc_id, lang, source, n_chars, sha256(text) AS text_sha256, CAST(0 AS BIGINT) AS runs_left, true AS merged FROM documents"


def op6_licenses(spark, sf_dir):
    return licenses.digest(licenses.scan(read(spark, sf_dir, "documents")))


def op7_tile_cosine(spark, sf_dir):
    return tile_cosine.near_vectors(read(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95
), r(node, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT p.b, r.root FROM r JOIN p ON p.a = r.node),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node), n AS (SELECT a, count(*) AS links FROM p GROUP BY a)
SELECT vec_id, CAST(coalesce(links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON vec_id = node LEFT JOIN n ON vec_id = a
"""


def op8_mixing(spark, sf_dir):
    return mixing.draws(read(spark, sf_dir, "documents")).withColumn("shards", F.array_join("shards", ","))


def mixing_targets(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    sizes = docs.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("source_size"))
    return mixing.targets(sizes).select("source", "source_size", F.round("target", 3).alias("target"))


MIXING_SQL = r"""
WITH s AS (
  SELECT source, sum(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')))::BIGINT AS n FROM documents GROUP BY source
), w AS (
  SELECT source, n, 2.0::DOUBLE * n AS cap, ([3, 1, 2])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM s
), l AS (
  SELECT *, cap / w AS ratio, (1.5 * (SELECT sum(n) FROM s) - coalesce(sum(cap) OVER before, 0)) / sum(w) OVER since AS level FROM w
  WINDOW before AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), since AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
)
SELECT source, n AS source_size, round(least(cap, coalesce(w * (SELECT arg_min(level, ratio) FROM l WHERE level <= ratio), cap)), 3) AS target FROM l
"""


def op9_byte_cnn(spark, sf_dir):
    return byte_cnn.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def default_vocabulary() -> tuple[str, str]:
    """Rank file and pre-tokenizer pattern of the installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op11_lexical_search(spark, sf_dir):
    return lexical_search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


#: Only A-Z become lower case.
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP11_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents
), n AS (SELECT doc_id, ts, len(ts) AS n FROM d WHERE len(ts) > 0),
c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM n),
p AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, n, unnest(ts) AS t FROM n) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY t, docs),
q AS (
  SELECT item_id, t, count(*) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY ALL
), s AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::BIGINT AS score
  FROM q JOIN w USING (t) JOIN p USING (t), c GROUP BY ALL
), r AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10
"""


def op12_divergence(spark, sf_dir):
    return divergence.audit(read(spark, sf_dir, "documents"))


OP12_SQL = rf"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all({LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents
), g AS (SELECT DISTINCT lang, source FROM d),
k AS (
  SELECT lang, term FROM (SELECT lang, unnest(list_distinct(ts)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 30
), c AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(ts) AS term FROM d) SEMI JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
s AS (SELECT lang, source, sum(n)::BIGINT AS total FROM c GROUP BY ALL),
x AS (
  SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n,
         1 + (1000000000 * (coalesce(n, 0) + 5)) // (coalesce(total, 0) + 5 * v) AS p
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN s USING (lang, source) LEFT JOIN c USING (lang, source, term)
), l AS (
  SELECT lang, term, 1 + (1000000000 * (sum(n)::BIGINT + 5)) // ((SELECT sum(total)::BIGINT FROM s WHERE s.lang = c.lang) + 5 * any_value(v)) AS q
  FROM c JOIN v USING (lang) GROUP BY lang, term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(f, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT m.lang, m.source, o.source AS item, sum(abs(m.p - o.p)) AS f
             FROM x m JOIN x o ON m.lang = o.lang AND m.term = o.term GROUP BY ALL) f
    ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
), terms AS (
  SELECT lang, source, term AS item, (p - q)::BIGINT AS value FROM x JOIN l USING (lang, term) WHERE n > 0 AND p > q
), r AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms
), o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM o WHERE part = 'pair' OR rank <= 50
"""


def op13_token_store(spark, sf_dir):
    import public_tokenizers

    return token_store.digest(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"warc_salvage": warc_salvage, "mixing_targets": mixing_targets, "op11_lexical_search": op11_lexical_search, "op12_divergence": op12_divergence, "op13_token_store": op13_token_store, "op1_secrets": op1_secrets, "op2_warc": op2_warc, "op4_byte_bpe": op4_byte_bpe, "op8_mixing": op8_mixing, "op3_simhash": op3_simhash, "op5_sharding": op5_sharding, "op6_licenses": op6_licenses, "op7_tile_cosine": op7_tile_cosine, "op9_byte_cnn": op9_byte_cnn, "op10_block_naming": op10_block_naming}
ORACLE = {"warc_salvage": SALVAGE_SQL, "mixing_targets": MIXING_SQL, "op11_lexical_search": OP11_SQL, "op12_divergence": OP12_SQL, "op7_tile_cosine": OP7_SQL, "op2_warc": OP2_SQL, "op5_sharding": OP5_SQL, "op6_licenses": licenses.oracle_sql(), "op10_block_naming": OP10_SQL}
