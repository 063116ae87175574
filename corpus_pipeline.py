"""Corpus pipeline: quality, near-duplicates, personal data, mixing, packing.

Each stage takes the documents that its predecessor kept, read from Parquet; ``run`` applies all
of them to the documents table, each stage's rows written under the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vigil.llm import cotrain, packing, pfair, pii, simhash_vp
from vigil.llm.common import table
from vigil.llm.queries import END_ID, tokenizer
from vigil.operators.materialize import discard, scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go.

    Null and empty texts are scored like others, as are rows of a null or repeated doc_id; rows alike fare alike. Without a
    usable label every row stays. An empty table stays empty.
    """
    return cotrain.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays, whatever its doc_id.

    Null and empty texts are one group, the texts without a word. Of rows equal in all columns one stays. An empty table stays empty.
    """
    return simhash_vp.keep_one(docs, unnamed_stay=False)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind.

    Null and empty texts stay as they are; every row is searched by itself. An empty table stays empty.
    """
    return pii.redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture: written files, and their rows, follow it.

    A null source is a source; rows of a null or repeated doc_id, and rows alike, have a position each. An empty table stays empty.
    """
    return pfair.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of up to 4096 tokens; one row per piece. Documents are packed in the order that mixing wrote.

    A null or empty text is the end id alone; rows alike are packed each. An empty table gives no pieces.
    """
    return packing.pack_documents(packing.in_written_order(docs), tokenizer("word_bpe_49k.json"), END_ID)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data),
          ("mixing", mixing), ("packing", packed)]

#: Fingerprints, trained models and tokenizers have no SQL form; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's table goes once the next one is written; only the last stage's input remains."""
    docs, read = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if read:
            discard(spark, read)
        read = path
    return STAGES[-1][1](spark, docs, sf_dir)
