"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardlens.llm import shared
from boardlens.llm.paths import tokenizer_file

BYTE_BPE = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold passages of benchmark items, substitutions tolerated."""
    from boardlens.llm import decontaminate

    return decontaminate.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents over five-word shingles, Jaccard 0.75 or more."""
    from boardlens.llm import jaccard

    found = jaccard.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id")


OP2_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
e AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * c >= 75 * (len(x.sh) + len(y.sh) - c)),
both_ways AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach(n, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.n, o.b FROM reach r JOIN both_ways o ON o.a = r.m)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, min(m) AS component_id FROM s JOIN reach ON n = s.doc_id GROUP BY ALL
"""


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as token ids in wavelet-matrix shards, read back: place, count and CRC of each."""
    from boardlens.llm import tokens

    out = shared.new_dir(spark, "token-shards")
    manifest = tokens.write_token_shards(table(spark, sf_dir, "documents"), out, tokenizer_file(BYTE_BPE), 2)
    return tokens.read_token_shards(manifest, with_ids=False).withColumnRenamed("key", "doc_id")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from boardlens.llm import htmltext

    pages = htmltext.extract(table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subword-lattice probability of every document, learned from four fifths of them."""
    from boardlens.llm import lm

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    scored = lm.score(docs, ~held_out, tokenizer_file("piece_bpe_32k.model"))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "lattice_score")


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors found for every vector whose id is divisible by 100."""
    from boardlens.llm import ann

    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, judged by who else holds them."""
    from boardlens.llm import secrets

    # A source is an owner; its part in one language stands for a repository.
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", F.when(F.col("source").isNotNull(), F.struct("source", "lang")).alias("repo"))
    found = secrets.find_secrets(docs, repo="repo", owner="source")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == secrets.KINDS.index(k))).cast("long").alias(f"n_{k}")
    live = F.size(F.filter("secrets", lambda s: s["verdict"] == "live")).cast("long")
    base = F.sha2(secrets.spans_text(F.col("base")).cast("binary"), 256)
    return found.select("doc_id", *[count(k) for k in secrets.KINDS[: secrets.BASE_KINDS]], base.alias("base_sha256"), secrets.spans_text(F.col("secrets")).alias("spans"), live.alias("n_live"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a classifier fitted to the labels it may learn from."""
    from boardlens.llm import toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(toxicity.with_labels(docs, table(spark, sf_dir, "labels")))
    scored = toxicity.score(docs, model)
    held_out = ~toxicity.learnable(F.col("doc_id"))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut and packed into sequences of 2048 ids: one row per piece."""
    from boardlens.llm import packing, token_pieces

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_pieces.token_pieces(docs, tokenizer_file(BYTE_BPE), 1, 2048)
    pieces = packing.pack(counted, "doc_tokens", "doc_id")
    crc = F.element_at("piece_crcs", (F.col("piece") + 1).cast("int"))
    return pieces.select("doc_id", "start", F.col("piece_length").alias("length"), crc.alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as WARC files, read back: digest, kind and reference of each record."""
    from boardlens.llm import warc

    manifest = warc.write_warc(table(spark, sf_dir, "pages"), shared.new_dir(spark, "warc"))
    records = warc.read_warc(manifest)
    return records.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p GROUP BY html)
SELECT p.page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(1 + ((CAST('0x' || substr(p.hex, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS BIGINT), 1)), '')
         AS payload_digest,
       CASE WHEN f.first = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f.first < p.page_id THEN f.first END AS refers_to
FROM p JOIN f USING (html)
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw documents to packed sequences: the stages of :mod:`boardlens.llm.pipeline`."""
    from boardlens.llm import pipeline as stages

    return stages.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontaminate, op2_jaccard, op3_token_shards, op4_html_text, op5_lm_score, op6_nearest, op7_secrets, op8_toxicity, op9_packing, op10_warc, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op2_jaccard": OP2_SQL, "op10_warc": OP10_SQL}
