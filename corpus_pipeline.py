"""From raw documents to packed training sequences.

Language ID drops documents whose language the network can't tell (no letter, or a score hardly above chance), near-dedup
leaves one document of each group, decontamination drops documents that hold a benchmark passage, secret scans put a mark in
place of each secret, packing returns the sequences.

Defined results: null texts and texts without a letter go in the first stage, as does all if no document has a label; of
repeated rows and of copies one row stays; a null doc_id cannot be named by a decision on single documents, so that
decontamination keeps such rows; an empty table, or a benchmark without items, leaves later stages what there is; texts of
any length are treated whole; extra columns, whatever their names, pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmint.llm import decontam, langid, packing, secrets, similarity
from parchmint.llm.common import materialize, table

LEAST_OF_CHANCE = 1.1  # a language's score must be so many times what each of the labels would have by chance


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs)
    return langid.keep_known(docs, model, least=LEAST_OF_CHANCE / max(2, len(model.languages)) if model else 0.0)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similarity.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return docs.join(materialize(found.select("doc_id").distinct(), "contaminated"), "doc_id", "left_anti").select(docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack),
]

#: SQL can express neither the network, the fingerprints, the alignment nor the tokenizer: tests/llm has brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
