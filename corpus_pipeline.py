"""Raw documents to a training mix, in five stages.

Each stage takes what its predecessor kept and gives documents (all columns of
the table) to the next; the last says how many words of each document the mix
takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merset.llm import language
from merset.llm.decontam import find_leaks
from merset.llm.mixture import mix_sources
from merset.llm.neardup import drop_near_duplicates
from merset.llm.secrets import redact_secrets
from merset.session import scratch


#: Languages that the pipeline keeps; None: all that were learned.
LANGUAGES: tuple[str, ...] | None = None


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the classifier assigns to one of LANGUAGES; a missing lang becomes the assigned one.

    Rejected are null and empty texts, texts without a letter, texts assigned
    to a language that is not wanted, and texts of 64 bytes and more that are
    near no single codeword (gibberish, or a language that was not learned). Where no row has a
    lang, nothing can be learned, and all texts with a letter stay as they are.
    """
    code = language.fit(docs)
    if not code.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    found = language.identify(docs.select(row, "text"), code, keep=("row",))
    kept = found.where(language.has_language(F.col("row.text"), F.col("lang_pred"), F.col("ambiguous")))
    if LANGUAGES is not None:
        kept = kept.where(F.col("lang_pred").isin(*LANGUAGES))
    return kept.select(*[F.coalesce("row.lang", "lang_pred").alias("lang") if c == "lang" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest id, of each group of near copies (five-word shingles, similarity 0.8)."""
    return drop_near_duplicates(docs, words=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item; others with the same or no doc_id stay."""
    row = F.xxhash64("doc_id", "text")
    leaks = find_leaks(docs.select(row.alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("doc_id").alias("_row_key")).distinct()
    return docs.withColumn("_row_key", row).join(leaks, "_row_key", "left_anti").select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents; secrets in them are replaced by a mark."""
    return redact_secrets(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of the documents that the mix takes."""
    return mix_sources(docs).where("taken > 0")


STAGES = [
    ("language", by_language),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", decontaminated),
    ("secrets", without_secrets),
    ("mixing", mixed),
]

#: SQL has no words for these stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
