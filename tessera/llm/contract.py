"""The queries of the text-corpus operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

import importlib

from pyspark.sql import functions as F

from tessera.llm import bpe, embedding_dedup, exact_dedup, langid, mixing, quality, simhash, suffix_dedup, url_filter, warc

URL_RULES = [
    url_filter.Rule("com", "/en/", "block"),
    url_filter.Rule("example.com", "/en/7", "allow"),
    url_filter.Rule("net", "/de/", "allow"),
    url_filter.Rule("example.net", "/de/8", "block"),
    url_filter.Rule("org", "/es/", "block"),
]


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.rules_table(spark, URL_RULES))


def op2_embedding_dedup(spark, sf_dir):
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op3_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit(docs))


def damaged(pages):
    """The pages with the record that a replica on a bad disk has in its place: some payloads changed, cut or lost."""
    kind = F.coalesce(F.pmod("page_id", F.lit(97)), F.lit(0))
    html = F.when(kind == 5, F.concat(F.lit("#"), F.expr("substring(html, 2)"))).when(kind == 77, F.expr("substring(html, 1, length(html) - 1)")).otherwise(F.col("html"))
    record = warc.record_bytes(F.col("url"), html)
    return pages.withColumns({"lost": kind == 41, "now_length": F.octet_length(record).cast("long"), "now_sha256": F.sha2(record, 256)})


def op4_warc_fixity(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    # The replica's index has the places of the original and hashes of what is there now.
    packed = warc.pack(damaged(pages), also=("lost", "now_length", "now_sha256"))
    replica = packed.where("not lost").select("archive", "offset", F.col("now_length").alias("length"), F.col("now_sha256").alias("sha256"))
    return warc.fixity(pages, replica)


def op5_simhash(spark, sf_dir):
    return simhash.near_groups(table(spark, sf_dir, "documents"), words=3, distance=2)


def op6_exact_dedup(spark, sf_dir):
    return exact_dedup.groups(table(spark, sf_dir, "documents"), keep="max")


def vocabulary() -> str:
    """Where the public tokenizers package keeps the default vocabulary."""
    return importlib.import_module("public_tokenizers").path("word_bpe_49k.json")


def op7_bpe(spark, sf_dir):
    return bpe.encoded(table(spark, sf_dir, "documents"), vocabulary(), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op8_suffix_dedup(spark, sf_dir):
    return suffix_dedup.removed(table(spark, sf_dir, "documents"), length=400)


def op9_mixing(spark, sf_dir):
    return mixing.mixture(table(spark, sf_dir, "documents")).drop("times")


def op10_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = langid.held_out(F.col("doc_id"))
    profiles = langid.fit(docs.where(~out))
    return langid.predict(docs, profiles, also={"held_out": out})


OP1_SQL = r"""
WITH parts AS (
  SELECT page_id,
         CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), split AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
)
SELECT page_id, host, path,
  CASE WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
       WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
       WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/en/') THEN 'com/en/'
       WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/de/') THEN 'net/de/'
       WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/es/') THEN 'org/es/' END AS rule,
  CASE WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/7') THEN 'allow'
       WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/de/8') THEN 'block'
       WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/en/') THEN 'block'
       WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/es/') THEN 'block'
       ELSE 'allow' END AS verdict
FROM split
"""

OP6_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


OP4_SQL = r"""
WITH bodies AS (
  SELECT page_id, url, page_id // 512 AS archive, coalesce(html, '') AS html,
         CASE page_id % 97 WHEN 5 THEN '#' || substr(html, 2) WHEN 77 THEN substr(html, 1, length(html) - 1) ELSE coalesce(html, '') END AS now,
         page_id % 97 = 41 AS lost
  FROM pages
), records AS (
  SELECT page_id, archive, lost,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
      || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS rec,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
      || 'Content-Length: ' || strlen(now) || chr(13) || chr(10) || chr(13) || chr(10) || now || chr(13) || chr(10) || chr(13) || chr(10) AS rec_now
  FROM bodies
), placed AS (
  SELECT page_id, archive, CAST(strlen(rec) AS BIGINT) AS length, sha256(rec) AS sha256, sha256(rec_now) AS sha_now, lost,
    CAST(sum(strlen(rec)) OVER (PARTITION BY archive ORDER BY page_id ROWS UNBOUNDED PRECEDING) - strlen(rec) AS BIGINT) AS "offset"
  FROM records
)
SELECT page_id, archive, "offset", length, sha256,
  CASE WHEN lost THEN NULL ELSE sha_now END AS replica_sha256,
  CASE WHEN lost THEN 'missing' WHEN sha256 <> sha_now THEN 'corrupt' ELSE 'ok' END AS status
FROM placed
"""


def pipeline(spark, sf_dir):
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)


def queries():
    return {
        "pipeline": pipeline,
        "op1_url_filter": op1_url_filter,
        "op2_embedding_dedup": op2_embedding_dedup,
        "op3_quality": op3_quality,
        "op4_warc_fixity": op4_warc_fixity,
        "op5_simhash": op5_simhash,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_bpe": op7_bpe,
        "op8_suffix_dedup": op8_suffix_dedup,
        "op9_mixing": op9_mixing,
        "op10_language_id": op10_language_id,
    }


def oracle_sql():
    return {"op1_url_filter": OP1_SQL, "op4_warc_fixity": OP4_SQL, "op6_exact_dedup": OP6_SQL}
