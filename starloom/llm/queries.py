"""Registered queries of the training-data operators.

Each query applies its operator, with production parameters, to a whole table
of ``sf_dir`` and returns the columns of its contract.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm import (
    alignment, ann, bpe_columns, collocations, kd_shards, minhash_dedup, ngram_join, packing, quality_classifier,
    quality_rules, token_files, url_rules, warc,
)
from starloom.llm.store import reach_workers, shared_folder

END_ID = 2
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reach_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "warc")
    warc.archive_pages(table(spark, sf_dir, "pages"), path)
    read = warc.read_archives(spark, path)
    page = F.regexp_extract("record_id", r"^urn:page:(-?\d+)$", 1)
    to = F.regexp_extract("refers_to", r"^urn:page:(-?\d+)$", 1)
    stored_bytes = F.col("payload").isNotNull()
    return read.select(
        F.when(page != "", page.cast("long")).alias("page_id"),
        F.when(stored_bytes, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(stored_bytes, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        F.when(F.coalesce(to, F.lit("")) != "", to.cast("long")).alias("refers_to"),
    )


OP1_SQL = """
WITH p AS (
    SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
    FROM pages
), top AS (
    SELECT payload_digest, max(page_id) AS top FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, p.payload_digest AS payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
FROM p LEFT JOIN top ON p.payload_digest = top.payload_digest
"""


def op2_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "tokens")
    docs = table(spark, sf_dir, "documents")
    token_files.write_token_files(docs, path, public_tokenizers.path("byte_bpe_50k.json"), END_ID)
    return token_files.read_digests(spark, path)


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kd_shards.shard_documents(table(spark, sf_dir, "documents"), 16)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash_dedup.near_components(table(spark, sf_dir, "documents"), 2, 80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


OP5_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
    FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) = 1 THEN words
        ELSE list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) END AS s
    FROM w
), classes AS (
    SELECT list_sort(s) AS k, min(doc_id) AS cid, any_value(len(s)) AS n FROM sets WHERE len(s) > 0 GROUP BY 1
), items AS (SELECT cid, n, unnest(k) AS item FROM classes
), pairs AS (
    SELECT a.cid AS a, b.cid AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS common
    FROM items a JOIN items b ON a.item = b.item AND a.cid < b.cid
         AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
    GROUP BY a.cid, b.cid
), links AS (
    SELECT a, b FROM pairs WHERE 100 * common >= 80 * (na + nb - common)
    UNION SELECT b, a FROM pairs WHERE 100 * common >= 80 * (na + nb - common)
), reach(a, b) AS (
    SELECT cid, cid FROM classes UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), comps AS (SELECT a AS cid, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id AS doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(p.component_id, s.doc_id) AS component_id,
       coalesce(p.component_id, s.doc_id) = s.doc_id AS kept
FROM sets s LEFT JOIN classes c ON c.k = list_sort(s.s) LEFT JOIN comps p ON p.cid = c.cid
"""


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID)


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_rules.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


OP7_SQL = r"""
WITH RECURSIVE named AS (
    SELECT page_id, url, html,
           translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
    FROM pages
), rules(host, path, verdict) AS (
    VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
           ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), tags AS (
    SELECT url, unnest(regexp_extract_all(html, '(?is)<link\b[^>]*\bcanonical\b[^>]*>')) AS tag
    FROM named WHERE contains(url, '://')
), links AS (
    SELECT url AS src, trim(regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''>\s]+)', 1)) AS link FROM tags
), targets AS (
    SELECT src, CASE WHEN contains(link, '://') THEN link
                     ELSE regexp_extract(src, '(?s)^(.*?://[^/?#]*)', 1) || link END AS dst
    FROM links WHERE link <> ''
), nodes AS (
    SELECT DISTINCT url, lower(regexp_extract(url, '(?s)^(.*?)://', 1)) || '://'
           || translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
           || CASE WHEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^#]*)', 1) = '' THEN '/'
                   ELSE regexp_extract(url, '(?s)^.*?://[^/?#]*([^#]*)', 1) END AS node
    FROM (SELECT url FROM named WHERE contains(url, '://') UNION SELECT dst FROM targets)
), edges AS (
    SELECT a.node AS a, b.node AS b FROM targets t JOIN nodes a ON a.url = t.src JOIN nodes b ON b.url = t.dst
    WHERE a.node <> b.node
), both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges
), reach(a, b) AS (
    SELECT a, a FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON e.a = r.b
), classes AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY a
), class_names AS (
    SELECT node, component, regexp_extract(node, '(?s)^.*?://([^/?#]*)', 1) AS host,
           regexp_extract(node, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
    FROM classes
), class_rules AS (
    SELECT component, (SELECT r.verdict FROM rules r WHERE (c.host = r.host OR ends_with(c.host, '.' || r.host))
                       AND starts_with(c.path, r.path) ORDER BY length(r.host || r.path) DESC LIMIT 1) AS verdict
    FROM class_names c
), condemned AS (
    SELECT component FROM class_rules GROUP BY component
    HAVING count(*) FILTER (WHERE verdict = 'block') > 0 AND count(*) FILTER (WHERE verdict = 'allow') = 0
), ruled AS (
    SELECT n.*, (SELECT struct_pack(rule := r.host || r.path, verdict := r.verdict) FROM rules r
                 WHERE (n.host = r.host OR ends_with(n.host, '.' || r.host)) AND starts_with(n.path, r.path)
                 ORDER BY length(r.host || r.path) DESC LIMIT 1) AS best
    FROM named n
)
SELECT r.page_id AS page_id, r.host AS host, r.path AS path, r.best.rule AS rule,
       coalesce(r.best.verdict, CASE WHEN d.component IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled r LEFT JOIN nodes n ON n.url = r.url LEFT JOIN classes c ON c.node = n.node
LEFT JOIN condemned d ON d.component = c.component
"""


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_quality(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe_columns.round_trip_digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


def _remainder() -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))


def op10_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_classifier.fit_classifier(docs, table(spark, sf_dir, "labels"), _remainder() != 2)
    held_out = F.coalesce(_remainder() == 2, F.lit(False)).alias("held_out")
    return quality_classifier.score_quality(docs, model).select("doc_id", held_out, "score", "predicted")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    paths = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.align_documents(docs, *paths)


def op12_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), 3, 90)


OP12_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
    FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
        ELSE list_distinct(list_transform(range(1, len(words) - 1),
                           lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) END AS s
    FROM w
), classes AS (
    SELECT list_sort(s) AS k, min(doc_id) AS cid, any_value(len(s)) AS n FROM sets WHERE len(s) > 0 GROUP BY 1
), items AS (SELECT cid, n, unnest(k) AS item FROM classes
), pairs AS (
    SELECT a.cid AS a, b.cid AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS common
    FROM items a JOIN items b ON a.item = b.item AND a.cid < b.cid
         AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
    GROUP BY a.cid, b.cid
), links AS (
    SELECT a, b FROM pairs WHERE 100 * common >= 90 * (na + nb - common)
    UNION SELECT b, a FROM pairs WHERE 100 * common >= 90 * (na + nb - common)
), reach(a, b) AS (
    SELECT cid, cid FROM classes UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), comps AS (SELECT a AS cid, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id AS doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(p.component_id, s.doc_id) AS component_id
FROM sets s LEFT JOIN classes c ON c.k = list_sort(s.s) LEFT JOIN comps p ON p.cid = c.cid
"""


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.phrase_collocations(table(spark, sf_dir, "documents"), 10, 50, 2000)


OP13_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), split AS (
    SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), f1 AS (
    SELECT lang, p, count(*) AS f FROM (SELECT lang, unnest(w) AS p FROM split) GROUP BY ALL
), totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang
), f2 AS (
    SELECT lang, p, count(*) AS f
    FROM (SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: {'x': w[i], 'y': w[i + 1]})) AS p FROM split)
    GROUP BY ALL HAVING count(*) >= 10
), f3 AS (
    SELECT lang, p, count(*) AS f
    FROM (SELECT lang, unnest(list_transform(range(1, len(w) - 1),
                 lambda i: {'x': w[i], 'y': w[i + 1], 'z': w[i + 2]})) AS p FROM split)
    GROUP BY ALL HAVING count(*) >= 10
), longer AS (
    SELECT lang, p, max(f) AS f FROM (
        SELECT lang, {'x': p.x, 'y': p.y} AS p, f FROM f3 UNION ALL SELECT lang, {'x': p.y, 'y': p.z}, f FROM f3
    ) GROUP BY lang, p
), cuts AS (
    SELECT c.lang AS lang, c.p.x || ' ' || c.p.y AS phrase, c.f AS a, 1 AS k, l.f AS l, r.f AS r
    FROM f2 c JOIN f1 l ON l.lang = c.lang AND l.p = c.p.x JOIN f1 r ON r.lang = c.lang AND r.p = c.p.y
    LEFT JOIN longer g ON g.lang = c.lang AND g.p = c.p
    WHERE g.f IS NULL OR 100 * g.f < 50 * c.f
    UNION ALL
    SELECT c.lang, c.p.x || ' ' || c.p.y || ' ' || c.p.z, c.f, 1, l.f, r.f
    FROM f3 c JOIN f1 l ON l.lang = c.lang AND l.p = c.p.x
    JOIN f2 r ON r.lang = c.lang AND r.p = {'x': c.p.y, 'y': c.p.z}
    UNION ALL
    SELECT c.lang, c.p.x || ' ' || c.p.y || ' ' || c.p.z, c.f, 2, l.f, r.f
    FROM f3 c JOIN f2 l ON l.lang = c.lang AND l.p = {'x': c.p.x, 'y': c.p.y}
    JOIN f1 r ON r.lang = c.lang AND r.p = c.p.z
), scored AS (
    SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM cuts
), lowest AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_hilbert": op2_hilbert,
    "op3_tokens": op3_tokens,
    "op4_shards": op4_shards,
    "op5_minhash": op5_minhash,
    "op6_packing": op6_packing,
    "op7_urls": op7_urls,
    "op8_rules": op8_rules,
    "op9_bpe": op9_bpe,
    "op10_classifier": op10_classifier,
    "op11_alignment": op11_alignment,
    "op12_ngrams": op12_ngrams,
    "op13_collocations": op13_collocations,
}
ORACLES: dict[str, str] = {
    "op1_warc": OP1_SQL,
    "op5_minhash": OP5_SQL,
    "op7_urls": OP7_SQL,
    "op12_ngrams": OP12_SQL,
    "op13_collocations": OP13_SQL,
}
