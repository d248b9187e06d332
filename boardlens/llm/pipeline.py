"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``. Texts that are null count as empty and
stay. A decision holds for a doc_id and its text (by its 64-bit hash), so rows
that repeat both are decided alike, and rows that share a doc_id only are not.
Rows whose doc_id is null are decided by their texts; among near-duplicates each
is a document of its own, after all that have a doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boardlens.llm import decontaminate, jaccard, packing, secrets, token_pieces, toxicity
from boardlens.llm.paths import tokenizer_file
from boardlens.llm.shared import materialise
from boardlens.operators.components import LOCAL_EDGES
from boardlens.plans.workers import ensure_importable

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SEQUENCE, END_ID = 2048, 1
MASK = "[secret]"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic (score below 0.5)."""
    ensure_importable(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(toxicity.with_labels(docs, labels))
    scored = toxicity.score(docs.select(*COLUMNS), model, out="toxicity")
    return scored.where(F.col("toxicity") < 0.5).select(*COLUMNS)


def _same_document(a: DataFrame, b: DataFrame) -> Column:
    """Equal doc_id (null with null) and equal text hash ``mark``."""
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["mark"] == b["mark"])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id (of equal ids, with the smallest hash)."""
    ensure_importable(spark)
    rows = materialise(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "near-rows")
    name = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", F.xxhash64("text").alias("mark"), "row")
    found = jaccard.near_duplicates(rows.select(name.alias("name"), "text"), key="name")

    def document(c: str) -> Column:
        return F.struct(f"{c}.nameless", f"{c}.doc_id", f"{c}.mark", F.when(F.col(f"{c}.nameless"), F.col(f"{c}.row")))

    copies = found.where(document("name") != document("component_id")).select("name.row")
    # One bit a row, by 64 rows, goes to the texts, which stay where they are.
    bits = materialise(copies.groupBy(F.shiftright("row", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(row & 63 as int))")).alias("bits")), "near-copies")
    if bits.count() <= LOCAL_EDGES:  # a checked number of pairs of 8 bytes
        bits = F.broadcast(bits)
    kept = rows.withColumn("at", F.shiftright("row", 6)).join(bits, "at", "left")
    return kept.where("bits IS NULL OR shiftright(bits, cast(row & 63 as int)) & 1 = 0").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    ensure_importable(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = docs.select(*COLUMNS, F.xxhash64("text").alias("mark"))
    found = decontaminate.find_overlaps(rows.select(F.struct("doc_id", "mark").alias("name"), "text"), items, key="name")
    leaks = found.select("name.doc_id", "name.mark").distinct()
    return rows.join(leaks, _same_document(rows, leaks), "left_anti").select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose live-looking credentials are masked; widely copied examples stay."""
    mark = F.xxhash64("text")
    found = secrets.find_secrets(docs.select("doc_id", "source", F.when(F.col("source").isNotNull(), F.struct("source", "lang")).alias("repo"), "text", mark.alias("mark")), repo="repo", owner="source")
    live = F.filter("secrets", lambda s: s["verdict"] == "live")
    marked = found.select("doc_id", "mark", live.alias("spans")).where(F.size("spans") > 0).dropDuplicates(["doc_id", "mark"])
    rows = docs.select(*COLUMNS, mark.alias("mark"))
    rows = rows.join(marked, _same_document(rows, marked), "left").select(*[rows[c] for c in COLUMNS], "spans")

    def step(acc, s):
        after = s["start"] >= acc["pos"]
        out = F.concat(acc["out"], F.substring(F.col("text"), acc["pos"] + 1, s["start"] - acc["pos"]), F.lit(MASK))
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), F.when(after, out).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    masked = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["pos"] + 1, F.length("text"))))
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(masked)
    n_chars = F.when(F.col("spans").isNull(), F.col("n_chars")).otherwise(F.length(masked).cast("long"))
    return rows.select("doc_id", text.alias("text"), "lang", "source", n_chars.alias("n_chars"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids cut and packed: one row per piece."""
    ensure_importable(spark)
    counted = token_pieces.token_pieces(docs.select("doc_id", "text"), tokenizer_file("byte_bpe_50k.json"), END_ID, SEQUENCE)
    pieces = packing.pack(counted, "doc_tokens", "doc_id", size=SEQUENCE)
    crc = F.element_at("piece_crcs", (F.col("piece") + 1).cast("int"))
    return pieces.select("doc_id", "start", F.col("piece_length").alias("length"), crc.alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]

#: Training a classifier is beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
