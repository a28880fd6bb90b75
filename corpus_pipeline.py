"""From raw documents to packed training sequences, in five stages.

Each stage is a function of (session, documents, folder of the tables); its result is written
as Parquet in the shared folder and read again as the next one's documents. All but the last
return the columns of ``documents``; ``n_chars`` follows the text where a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hedonica import session
from hedonica.llm import decontaminate, packing, pii, quality, simhash
from hedonica.llm.common import table
from hedonica.session import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the limits of their language and source reject go."""
    return quality.good_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of least id stays."""
    return simhash.without_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more lies in benchmark passages go."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the name of its kind."""
    out = pii.redacted(docs)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, end_id=1)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("PII", personal_data),
    ("packing", packed_sequences),
]

# Packing needs a tokenizer, which SQL does not have; tests compare with plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What earlier stages have written is deleted once it is used."""
    docs, used = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        known = len(session.paths)
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        made = session.paths[known:]
        session.delete(spark, used + made[:-1])
        used = made[-1:]
    return docs
