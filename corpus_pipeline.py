"""The corpus pipeline: toxicity, language, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return the columns
of ``documents``. Rows that share a doc_id are one document; the near-duplicate stage keeps one row of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm import language, toxicity
from recordloom.llm.common import cut, id_fold, remove_path, scratch_path, table
from recordloom.llm.minhash import near_duplicates
from recordloom.llm.packing import pack_documents
from recordloom.llm.privacy import sanitize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more go. Learned from the labels outside the held-out fold."""
    labels = table(spark, sf_dir, "labels")
    held = id_fold(F.col("doc_id"), toxicity.LEARN_FOLDS) == toxicity.HELD_OUT
    model = toxicity.train(docs.where(~held), labels.where(~held), "doc_id", "text", "toxic")
    return toxicity.keep_by_score(docs, "text", model)


def drop_unknown_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in none of the learned languages with a score of at least 0.3, go."""
    held = id_fold(F.col("doc_id"), language.LEARN_FOLDS) == language.HELD_OUT
    model = language.train(docs.where(~held), "doc_id", "text", "lang")
    return language.keep_known_languages(docs, "text", model, 0.3)


def _counted(ids: DataFrame, broadcast_ids: int) -> DataFrame:
    """Ids to join with; up to ``broadcast_ids`` are sent to the rows, so that whole texts stay where they are."""
    ids = cut(ids)
    return F.broadcast(ids) if ids.count() <= broadcast_ids else ids


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str, broadcast_ids: int = 1_000_000) -> DataFrame:
    """Of each group of documents linked at a similarity of 0.8, the one with the least id stays.

    Of different rows that share that id, the least by text and then the other columns is the one.
    """
    found = cut(near_duplicates(docs, "doc_id", "text", percent=80).select("doc_id", "kept"))
    gone = _counted(found.where("not kept").select("doc_id").distinct(), broadcast_ids)
    left = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    repeated = _counted(found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), broadcast_ids)
    if repeated.isEmpty():
        return left
    columns = ["text", *(c for c in docs.columns if c != "text")]
    several = left.join(repeated, "doc_id", "left_semi").groupBy("doc_id")
    once = several.agg(F.min(F.struct(*[F.col(f"`{c}`") for c in columns])).alias("_row")).select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
    return left.join(repeated, "doc_id", "left_anti").select(docs.columns).unionAll(once)


def take_out_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are replaced; ``n_chars`` follows the new text."""
    clean = sanitize(docs, "doc_id", "text")
    n_chars = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return clean.withColumn("n_chars", n_chars).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as sequences of at most 1024 tokens; one row for each piece."""
    import public_tokenizers

    return pack_documents(docs, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_languages),
    ("near_dedup", drop_near_duplicates),
    ("personal_data", take_out_personal_data),
    ("packing", pack),
]

#: SQL can express none of the trained stages; the stages are tested against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            path = scratch_path(spark, f"stage-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                remove_path(spark, before)
            before = path
    return docs
