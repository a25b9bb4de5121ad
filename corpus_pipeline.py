"""A corpus pipeline of five operators, each reading what the one before kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns
a DataFrame. All but the last return the columns of ``docs``. ``run`` applies them to
the documents table and writes each result as Parquet before the next one reads it.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlscape.llm import bpe, jaccard, mixing, pii, quality
from crawlscape.llm.common import Scratch, parquet


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: learns from the labels and keeps documents scored 0.3 or more."""
    model = quality.train(docs, parquet(spark, sf_dir, "labels"))
    return quality.score(docs, model, keep=tuple(docs.columns), out="__score").where(F.col("__score") >= quality.THRESHOLD).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each component the document with the smallest id stays, one row of it.

    Documents without shingles are groups of their own; so are null ids.
    """
    found = jaccard.near_components(docs.select("doc_id", "text"), label="stage-jaccard")
    first = found.where("doc_id = component_id").select("doc_id").distinct()
    rest = [c for c in docs.columns if c != "doc_id"]
    kept = docs.join(first, "doc_id").groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("__row"))
    return kept.select("doc_id", *[F.col(f"__row.`{c}`").alias(c) for c in rest]).select(*docs.columns).unionByName(docs.where("doc_id is null"))


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII: every span found is replaced by its kind in brackets; n_chars follows the new text."""
    clean = pii.redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return clean.select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to square-root weights: all rows, laid out over files and rows by their slot in the mix."""
    shares = mixing.tempered_shares(docs)
    if not shares:
        return docs
    total = docs.count()
    rows = docs.select("doc_id", "source", F.struct("*").alias("__row"))
    slots = mixing.mix(rows, shares, total=total)
    files = max(1, min(4096, -(-total // 5000)))
    return slots.repartitionByRange(files, "slot", "row_in_block").sortWithinPartitions("slot", "row_in_block").select("__row.*")


def with_position(docs: DataFrame) -> DataFrame:
    """Adds ``position``: rows in order of the written files' numbers and of the rows in them, whatever order
    the files are read in. Null for rows that come from no Parquet file."""
    name = F.col("_metadata.file_name")
    number = lambda pattern: F.coalesce(F.regexp_extract(name, pattern, 1).try_cast("long"), F.lit(0))
    try:
        return docs.withColumn("position", F.shiftleft(number("^part-(\\d+)"), 44) + F.shiftleft(number("-c(\\d+)\\."), 32) + F.col("_metadata.row_index"))
    except AnalysisException:
        return docs.withColumn("position", F.lit(None).cast("long"))


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE: token counts and digests of ids and of the decoded text, and the ``position`` of each row in the mix."""
    kept = tuple(c for c in ("doc_id", "lang", "source", "n_chars") if c in docs.columns)
    return bpe.bpe(with_position(docs), bpe.word_bpe_path(), keep=(*kept, "position"))


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", one_of_each_group),
    ("PII", without_pii),
    ("mixing sources to target weights", mixed),
    ("BPE encoding and decoding", tokenized),
]

#: A trained classifier, a tokenization automaton and validated spans are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = parquet(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        made = len(Scratch.made)
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage-{k}")
        Scratch.drop_since(made)
        scratch.only(f"stage-{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
