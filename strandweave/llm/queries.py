"""One query for each text operator, over its whole table, with oracle SQL where SQL can express it."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm import fingerprint, jaccard, langid, line_dedup, negatives, packing, quality, runs, sentencepiece_codec, sharding, toxicity, urlfilter, warc
from strandweave.llm._common import table

SHARDS = 24


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentencepiece_codec.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.dedup_lines(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.balanced_shards(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = langid.fit(docs.where(fold != 1))
    named = langid.identify(docs, model, keep=("doc_id",))
    return named.select("doc_id", (fold == 1).alias("held_out"), "lang_pred", "score", "n_switches")


def op5_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as WARC records against a replica with known damage: a byte changed in some records, others gone from their places."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    hurt = F.when(F.col("page_id") % 97 == 5, F.concat(F.lit("!"), F.substring("html", 2, 1 << 30))).otherwise(F.col("html"))
    good, bad = (warc.record(F.col("page_id"), F.col("url"), body) for body in (F.col("html"), hurt))
    both = pages.select("page_id", good.alias("record"), bad.alias("bad"))
    sizes = [F.octet_length("bad").cast("bigint").alias("bad_length"), F.sha2(F.col("bad").cast("binary"), 256).alias("bad_sha256")]
    laid = warc.lay_out(both.select(F.col("page_id").alias("id"), F.octet_length("record").cast("bigint").alias("length"), F.sha2(F.col("record").cast("binary"), 256).alias("sha256"), *sizes))
    replica = laid.where("coalesce(id % 193 <> 7, true)").select("archive", "offset", F.col("bad_length").alias("length"), F.col("bad_sha256").alias("sha256"), "id")
    found = warc.audit(laid, replica)
    return found.select(F.col("id").alias("page_id"), "archive", F.col("offset").alias("byte_offset"), F.col("length").alias("byte_length"), F.col("sha256").alias("record_sha256"), "status")


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_documents(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list holds the URLs of hosts of every junk category, and a sixteenth of all URLs by digest, which no rule on hosts implies."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = urlfilter.judge_urls(pages, urlfilter.listed_by_label(pages).unionByName(urlfilter.listed_by_digest(pages)))
    return judged.select("page_id", "host", "path", "rule", "verdict", "is_listed")


def op7_url_filter_junk_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``op7_url_filter``, with the URLs of hosts of every junk category alone in the list."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = urlfilter.judge_urls(pages, urlfilter.listed_by_label(pages))
    return judged.select("page_id", "host", "path", "rule", "verdict", "is_listed")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=("doc_id",))


def op8_quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``op8_quality_rules`` that SQL can express."""
    return op8_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_next(table(spark, sf_dir, "documents"))


def op9_edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``op9_fingerprints`` that SQL can express."""
    return op9_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = toxicity.fold_of(F.col("doc_id"), 4)
    model = toxicity.fit(docs.where(fold != 2), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    scored = toxicity.score(docs, model, keep=("doc_id",))
    return scored.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def periodic_tails(ids: pa.Array, first: np.ndarray) -> np.ndarray:
    """The word that stands at each place once a tenth of the texts, by crc32 of the id, repeat a stretch of theirs to the end."""
    source = np.arange(first[-1])
    for doc_id, start, n in zip(ids.to_pylist(), first[:-1].tolist(), np.diff(first).tolist(), strict=True):
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            source[start + a : start + n] = start + a + np.arange(n - a) % p
    return source


def op12_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(table(spark, sf_dir, "documents"), rewrite=periodic_tails)
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("length"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    length, period = -F.col("best.length"), F.col("best.period")
    return found.withColumn("best", best).select(
        "doc_id", "n_runs", F.col("best.start").alias("start"), length.alias("length"), period.alias("period"), F.expr("-best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.mine(moved, F.col("id") % 100 == 0, "vec_id", "embedding", "label", scale=256)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sentencepiece": op1_sentencepiece,
        "op2_line_dedup": op2_line_dedup,
        "op3_sharding": op3_sharding,
        "op4_language_id": op4_language_id,
        "op5_warc_fixity": op5_warc_fixity,
        "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
        "op7_url_filter": op7_url_filter,
        "op7_url_filter_junk_labels": op7_url_filter_junk_labels,
        "op8_quality_rules": op8_quality_rules,
        "op8_quality_base": op8_quality_base,
        "op9_fingerprints": op9_fingerprints,
        "op9_edited_texts": op9_edited_texts,
        "op10_packing": op10_packing,
        "op11_toxicity": op11_toxicity,
        "op12_word_runs": op12_word_runs,
        "op13_hard_negatives": op13_hard_negatives,
    }


_OP2 = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), repeated AS (
  SELECT key, min(doc_id) AS holder FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
), marked AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id <> r.holder, false) AS dropped
  FROM keyed k LEFT JOIN repeated r ON k.key = r.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_OP7 = """
WITH parts AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), split AS (
  SELECT page_id, rest,
         coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
         list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\\?([^#]*)', 1), '&'),
                               lambda p: p <> '' AND NOT starts_with(p, 'utm_') AND NOT starts_with(p, 'ref='))) AS query
  FROM parts
), canon AS (
  SELECT page_id, host, path, CASE WHEN rest IS NOT NULL THEN host || regexp_replace(path, '/+$', '')
         || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END END AS canonical
  FROM split
), listed AS (
  SELECT DISTINCT canonical FROM canon WHERE list_has_any(string_split(host, '.'), ['ads-track', 'adult-x', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm'])
     OR md5(canonical)[1] = '7'
), rules(rule, rule_host, rule_path, verdict) AS (
  VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
         ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')
), fit AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM canon, rules WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id
)
SELECT c.page_id, c.host, c.path, f.rule,
       coalesce(f.verdict, CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, l.canonical IS NOT NULL AS is_listed
FROM canon c LEFT JOIN fit f USING (page_id) LEFT JOIN listed l ON c.canonical = l.canonical
"""

_OP7_JUNK = _OP7.replace("     OR md5(canonical)[1] = '7'\n", "")


_OP5 = """
WITH records AS (
  SELECT page_id, html,
         'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
         || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
         || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '')
         || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM pages
), hashed AS (
  SELECT page_id, strlen(record)::BIGINT AS byte_length, sha256(record) AS record_sha256,
         CASE WHEN page_id % 193 = 7 THEN 'missing'
              WHEN page_id % 97 = 5 AND '!' || substr(html, 2) <> html THEN 'corrupt' ELSE 'intact' END AS status
  FROM records
), placed AS (
  SELECT *, coalesce(sum(byte_length) OVER (ORDER BY page_id NULLS FIRST, record_sha256 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM hashed
)
SELECT page_id, start // 16777216 AS archive, start - min(start) OVER (PARTITION BY start // 16777216) AS byte_offset, byte_length, record_sha256, status
FROM placed
"""

_OP6 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM words
), sizes AS (
  SELECT d.doc_id, count(s.s)::BIGINT AS n FROM documents d LEFT JOIN shingles s USING (doc_id) GROUP BY d.doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)
), edges AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other
)
SELECT s.doc_id, s.n AS n_shingles, (SELECT min(other) FROM reach r WHERE r.doc_id = s.doc_id) AS component_id FROM sizes s
"""


_OP8 = r"""
WITH words AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS g
  FROM words WHERE len(w) >= 8
), twice AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS times FROM grams) WHERE times > 1
), covered AS (
  SELECT doc_id, count(DISTINCT pos)::BIGINT AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS pos FROM twice) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
)
SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
       length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(l.n, 0)::BIGINT AS n_dup_lines,
       coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(w) < 20 OR 100 * coalesce(c.n, 0) > 30 * len(w) AS base_failed
FROM words w LEFT JOIN covered c USING (doc_id) LEFT JOIN lines l USING (doc_id)
"""

_OP9 = """
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id), first_value(coalesce(text, '')) OVER (ORDER BY doc_id)) AS next
  FROM documents
)
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(substr(text, 1, length(text) - length(text) // 4) || substr(next, 1, length(text) // 4)) AS edited_sha256
FROM texts
"""


_OP13 = """
WITH known AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM known a JOIN known b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), found AS (
  SELECT p.anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank
  FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM found WHERE rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_dedup": _OP2, "op5_warc_fixity": _OP5, "op6_ngram_jaccard_join": _OP6, "op7_url_filter": _OP7, "op7_url_filter_junk_labels": _OP7_JUNK,
        "op8_quality_base": _OP8, "op9_edited_texts": _OP9, "op13_hard_negatives": _OP13,
    }
