"""The registered queries of the text operators, each beside its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import encode
from .clustering import cluster_vectors
from .decontamination import WIDTH, find_matches, words_hit
from .embedding_dedup import near_vectors
from .language_id import fit_prototypes, identify, training_fold
from .line_dedup import MIN_SITES, remove_boilerplate
from .minhash import compare_with_next
from .packing import pack, token_pieces
from .passages import shared_passages
from .simhash import simhash_groups
from .suffix_dedup import remove_repeats
from .url_filter import Rule, host_and_path, judge_urls
from .vector_codes import compress_vectors
from .vector_sql import clustering_sql, vector_codes_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_language_id")
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_prototypes(training_fold(docs))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )


@query("op7_simhash")
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(table(spark, sf_dir, "documents"))
    digits = F.lpad(F.lower(F.hex("fingerprint")), 16, "0")
    return groups.select(
        F.col("doc").alias("doc_id"), digits.alias("fingerprint"), "component_id"
    )


LINE_SPREAD = f"""
WITH lines AS (
  SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents
), bad AS (
  SELECT line FROM lines WHERE trim(line) <> ''
  GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}
), numbered AS (
  SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), pieces AS (
  SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM numbered
), kept AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (bad.line IS NOT NULL) AS gone,
         coalesce(string_agg(pieces.line, chr(10) ORDER BY pos) FILTER (bad.line IS NULL), '') AS rest
  FROM pieces LEFT JOIN bad ON pieces.line = bad.line GROUP BY doc_id
)
SELECT doc_id, n AS n_lines, gone AS n_removed, sha256(rest) AS kept_sha256 FROM kept
"""


@query("op10_line_dedup", LINE_SPREAD)
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    kept = remove_boilerplate(docs, counts=("n_lines", "n_removed"))
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return kept.select("doc_id", "n_lines", "n_removed", digest.alias("kept_sha256"))


@query("op4_suffix_dedup")
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = remove_repeats(docs)
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return found.select(
        "doc_id",
        n_bytes.alias("n_bytes"),
        (n_bytes - F.octet_length("kept")).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        (F.size("removed") > 0).alias("repeats"),
    )


@query("op5_best_fit_packing")
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pack(pieces).withColumnRenamed("doc", "doc_id")


@query("op6_byte_bpe")
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = encode(docs, path, decoded="decoded")
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


URL_RULES = [
    Rule.parse("allow", "org/"),
    Rule.parse("block", "example.org/es/"),
    Rule.parse("block", "example.org/en/1"),
    Rule.parse("allow", "com/fr/"),
    Rule.parse("block", "com/de/"),
]
#: pages of these sites are the list
LISTED_SITES = "(^|[.])(ads-track|spam-farm|casino-win|adult-x|cheap-pills|free-bets)[.]"

URL_VERDICTS = f"""
WITH parts AS (
  SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0
    THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), rules(verdict, host, path) AS (
  VALUES ('allow','org','/'), ('block','example.org','/es/'), ('block','example.org','/en/1'),
         ('allow','com','/fr/'), ('block','com','/de/')
), fits AS (
  SELECT page_id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
         arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM split s JOIN rules r ON (s.host = r.host OR ends_with(s.host, '.' || r.host))
   AND starts_with(s.path, r.path) GROUP BY page_id
)
SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.verdict,
  CASE WHEN regexp_matches(s.host, '{LISTED_SITES}') THEN 'block' ELSE 'allow' END) AS verdict
FROM split s LEFT JOIN fits f USING (page_id)
"""


@query("op2_url_filter", URL_VERDICTS)
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.where(host_and_path(F.col("url"))[0].rlike(LISTED_SITES))
    judged = judge_urls(pages, listed, URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op9_embedding_dedup")
def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


@query("op8_minhash")
def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compare_with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        F.col("doc").alias("doc_id"),
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
    )


@query("op3_passages")
def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shared_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    others = F.array_union("passages.other", F.array("copy_of"))
    linked = F.array_sort(F.filter(others, lambda x: x != F.col("doc_id")))
    return found.withColumnRenamed("doc", "doc_id").withColumn("linked", linked)


WORD_RUNS = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
LEAKS = f"""
WITH said AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '{WORD_RUNS}') AS words FROM documents
), asked AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '{WORD_RUNS}') AS words FROM benchmark
), sized AS (
  SELECT item_id, words, least(len(words), {WIDTH}) AS need FROM asked WHERE len(words) > 0
), starts AS (
  SELECT item_id, words, need, unnest(range(1, len(words) - need + 2)) AS pos FROM sized
), windows AS (
  SELECT DISTINCT item_id, need, array_to_string(words[pos:pos + need - 1], ' ') AS said FROM starts
), needs AS (SELECT DISTINCT need FROM windows), places AS (
  SELECT doc_id, words, need, unnest(range(1, len(words) - need + 2)) AS pos
  FROM said, needs WHERE len(words) >= need
), found AS (
  SELECT DISTINCT p.doc_id, p.pos, p.need, w.item_id FROM places p
  JOIN windows w ON w.need = p.need AND w.said = array_to_string(p.words[p.pos:p.pos + p.need - 1], ' ')
), hit AS (
  SELECT doc_id, count(DISTINCT place) AS n FROM (
    SELECT doc_id, unnest(range(pos, pos + need)) AS place FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS listed FROM (
    SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found WHERE item_id IS NOT NULL)
  GROUP BY doc_id
)
SELECT s.doc_id, CAST(len(s.words) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit,
       coalesce(i.n, 0) AS n_items, sha256(coalesce(i.listed, '')) AS items_sha256,
       coalesce(h.n, 0) > 0 AS contaminated
FROM said s LEFT JOIN hit h USING (doc_id) LEFT JOIN items i USING (doc_id)
"""


@query("op11_decontamination", LEAKS)
def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_matches(docs, table(spark, sf_dir, "benchmark"), keep_text=False)
    n_hit = words_hit(F.col("hit_spans"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


@query("op12_centroid_clustering", clustering_sql())
def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings")).drop("centroid")


@query("op13_vector_codes", vector_codes_sql())
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_vectors(table(spark, sf_dir, "embeddings"))[0].drop("label")
