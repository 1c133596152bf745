"""The registered query of each operator, with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_engine.llm import (
    decontam,
    hashing_search,
    html_extract,
    jaccard_join,
    language_id,
    licence_scan,
    line_dedup,
    merkle,
    mixing,
    oracle_sql,
    phrases,
    piece_encoding,
    quality,
    warc,
)
from corpus_engine.llm.frames import in_bucket, stored
from corpus_engine.session import shared_folder
from corpus_engine.tables import load

Query = Callable[[SparkSession, str], DataFrame]


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page through a WARC archive and back: length and digest of its payload, and what it revisits.

    Every row is a record of its own, also rows without a page id and rows that are equal in everything: the id of a record
    begins with the row's place in the table, which is the same whenever the table's files are read.
    """
    pages = load(spark, sf_dir, "pages").withColumn("_row", F.monotonically_increasing_id())
    record_id = F.concat(F.lpad(F.hex("_row"), 16, "0"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    page_of = lambda c: F.substring(c, 17, 20).try_cast("long")
    order = F.coalesce(page_of(F.col("record_id")), F.lit((1 << 63) - 1))
    files = warc.archive(pages, record_id, order, F.col("url"), F.col("html"), shared_folder(spark))
    back = warc.read_archives(spark, files, with_data=False)
    return back.select(
        page_of(F.col("record_id")).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        page_of(F.col("refers_to")).alias("refers_to"),
    )


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    out = html_extract.extract(load(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("_text").alias("text"), F.length("_text").cast("long").alias("n_chars"))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles and component of near copies of every document."""
    return jaccard_join.link_documents(load(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from labels outside the held-out fifth."""
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    weights = quality.train(docs, labels.filter(~in_bucket("doc_id", 5, 0)))
    out = quality.score(docs.select("doc_id", "text"), weights)
    score = F.col("_score").alias("score")
    return out.select("doc_id", in_bucket("doc_id", 5, 0).alias("held_out"), score, (F.col("_score") >= 0.3).cast("int").alias("predicted"))


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document, its own or that of the nearest directory above.

    Documents have no paths; one is derived from source and number: a hundred documents to a directory, a thousand
    to the one above, and every hundredth document is the licence file of its directory.
    """
    number = F.col("doc_id")
    name = F.when(number % 1000 == 0, F.lit("LICENSE")).otherwise(
        F.concat(F.floor(number % 1000 / 100).cast("string"), F.when(number % 100 == 0, F.lit("/LICENSE")).otherwise(F.concat(F.lit("/"), number.cast("string"), F.lit(".txt"))))
    )
    path = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.floor(number / 1000).cast("string"), F.lit("/"), name)
    docs = load(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text")
    out = licence_scan.inherit(stored(licence_scan.scan(docs).drop("text")))
    return out.select(
        "doc_id",
        "path",
        F.col("_licence").alias("licence"),
        F.col("_cosine").alias("cosine"),
        F.col("_effective").alias("effective"),
        F.col("_inherited_from").alias("inherited_from"),
    )


def op6_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy of a benchmark item in a document, with its score and place."""
    return decontam.copies(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")).drop("row_key")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the three quarters that are not held out."""
    docs = load(spark, sf_dir, "documents")
    model = language_id.train(docs.filter(~in_bucket("doc_id", 4, 2)), "doc_id", "text", "lang")
    out = language_id.identify(docs.select("doc_id", "text"), model)
    held_out = in_bucket("doc_id", 4, 2).alias("held_out")
    return out.select("doc_id", held_out, F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"), F.col("_ambiguous").alias("ambiguous"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth vector."""
    return hashing_search.nearest(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines dropped and digest of what stays, per document."""
    out = line_dedup.dedup_lines(load(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.sha2(F.coalesce("text", F.lit("")), 256)
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), kept.alias("kept_sha256"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    return mixing.mix(load(spark, sf_dir, "documents"))


def op11_pieces(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    """Pieces of every document, and digests of its ids and of the text decoded from them."""
    path = model_path or public_tokenizers.path("piece_bpe_32k.model")
    ids = piece_encoding.encode(load(spark, sf_dir, "documents").select("doc_id", "text"), path, settled=True)
    out = piece_encoding.decode(ids, path)
    listed = F.array_join(F.col("_ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("_ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("_text", 256).alias("decoded_sha256"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest, proof and verdict of every document; every third or so is tampered with after the proof."""
    docs = load(spark, sf_dir, "documents")
    text = F.col("text")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    folded = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(in_bucket("doc_id", 3, 0), merkle.leaf_digest([*fields, folded])).alias("tampered")
    rows = docs.select("doc_id", "lang", merkle.leaf_digest([*fields, text]).alias("digest"), tampered)
    manifest = merkle.build(rows, F.col("digest"), F.col("lang"), F.col("doc_id"))
    root = F.lit(manifest.root)
    claimed = F.coalesce("row.tampered", "leaf")
    out = merkle.prove(manifest).withColumn("folded_root", merkle.folded(claimed, F.col("path")))
    return out.select(
        F.col("row.doc_id").alias("doc_id"),
        merkle.hexed(F.col("leaf")).alias("leaf"),
        merkle.hexed(F.col("subroot")).alias("subroot"),
        root.alias("root"),
        merkle.proof_digest(F.col("path")).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == root).alias("verified"),
    )


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of each language."""
    return phrases.mine(load(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_warc": op1_warc,
    "op2_html": op2_html,
    "op3_jaccard": op3_jaccard,
    "op4_quality": op4_quality,
    "op5_licences": op5_licences,
    "op6_decontam": op6_decontam,
    "op7_language": op7_language,
    "op8_nearest": op8_nearest,
    "op9_line_dedup": op9_line_dedup,
    "op10_mixing": op10_mixing,
    "op11_pieces": op11_pieces,
    "op12_merkle": op12_merkle,
    "op13_phrases": op13_phrases,
}

# A key: the line stripped of [\x20\x09-\x0D] at both ends, A-Z in lower case.
OP9_SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
firsts AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT k.doc_id, pos, line, f.first IS NOT NULL AND f.first <> k.doc_id AS gone
  FROM keyed k LEFT JOIN firsts f ON f.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

# The digest as bare upper-case base32, five hexadecimal digits for each four letters.
OP1_SQL = r"""
WITH hashed AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, upper(sha1(coalesce(html, ''))) AS hexed FROM pages),
digests AS (
  SELECT page_id, payload_bytes, list_aggregate(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
      (CAST('0x' || substr(hexed, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1)), 'string_agg', '') AS payload_digest
  FROM hashed),
firsts AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first,
    row_number() OVER (PARTITION BY payload_digest, payload_bytes ORDER BY page_id NULLS LAST) AS place FROM digests)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN place > 1 THEN first END AS refers_to
FROM firsts
"""

ORACLES: dict[str, str] = {
    "op1_warc": OP1_SQL,
    "op9_line_dedup": OP9_SQL,
    "op12_merkle": oracle_sql.merkle(),
    "op13_phrases": oracle_sql.PHRASES,
}
