"""A corpus pipeline of five stages; counted as part of gossamer.llm.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept and returns a DataFrame, which `run` writes as Parquet to the shared
folder and rereads as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gossamer.llm import decontaminate, packing, quality, secrets, simhash
from gossamer.llm.queries import vocabulary
from gossamer.llm.shared import materialize
from gossamer.session import prepare, read_table

#: Other columns that a documents table may have are dropped, whatever their names.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score under 0.3) go."""
    docs = docs.select(*COLUMNS)
    model = quality.learn(docs, read_table(prepare(spark), sf_dir, "labels"))
    return quality.score(docs, model, docs.columns).where("score >= 0.3").select(*docs.columns)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest doc_id, and of equal ids the smallest text."""
    return simhash.deduplicate(docs.select(*COLUMNS))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    docs = docs.select(*COLUMNS)
    found = decontaminate.decontaminate(docs, read_table(prepare(spark), sf_dir, "benchmark"), keep=docs.columns)
    return found.where(~decontaminate.contaminated(F.col("n_words"), decontaminate.n_hit("spans"))).select(*docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret's span is replaced by a mark; n_chars follows."""
    return secrets.redact(docs.select(*COLUMNS))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, with their ids."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("simhash", simhash_stage),
    ("decontaminate", decontaminate_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]
#: Trained models, XXH64 and vocabularies are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from documents to packed pieces."""
    docs = read_table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
