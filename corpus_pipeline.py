"""From a documents table to token files: five stages, each over all that the one before it kept.

Null ids are kept and judged by their rows' texts; rows that repeat a doc_id share what near-duplicate
search decides for that id. Null and empty texts leave with the first stage. Other
columns of the table travel along under whatever names they have, also with dots or names that an
operator uses itself: a stage packs them before it calls its operator. An empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.llm import decontaminate, language, mixing, near_dedup, token_files
from murmur.session import materialize, scratch_path


READ = ("doc_id", "text", "lang", "source")  # the columns that operators read; all others are only carried


def _packed(docs: DataFrame) -> DataFrame:
    """The columns that operators read, and all others in one column ``carried``."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in READ]
    return docs.select(*READ, F.struct(F.lit(0).alias("carried"), *[c.alias(f"c{i}") for i, c in enumerate(others)]).alias("carried"))


def _unpacked(packed: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``, in their order."""
    place = {c: i for i, c in enumerate(c for c in like.columns if c not in READ)}
    return packed.select(*[F.col(c) if c in READ else F.col("carried")[f"c{place[c]}"].alias(c) for c in like.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned; those without a letter have none.

    Where no document that may teach names a language, nothing is learned and those with a letter stay.
    """
    model = language.train(docs)
    if not model.languages:
        return docs.filter(language.has_letter("text"))
    judged = language.identify(_packed(docs), model)
    return _unpacked(judged.filter(F.col("lang_pred") != language.UNKNOWN), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of near duplicates: the one with the least doc_id."""
    gone = near_dedup.near_duplicates(docs).filter("not kept").select("doc_id").distinct()
    return docs.join(materialize(gone, "near-duplicates"), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    clean = decontaminate.drop_contaminated(_packed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _unpacked(clean, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return _unpacked(mixing.mixed_documents(_packed(docs)), docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of what was written, read from the files."""
    path = scratch_path(spark, "pipeline-tokens")
    token_files.write_token_files(docs, path)
    return token_files.read_token_files(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("contamination", drop_contaminated),
    ("mixing", mix_sources),
    ("tokens", write_tokens),
]

ORACLE_SQL = None  # none of the stages can be expressed in SQL; tests hold them against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
