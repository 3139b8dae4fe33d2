"""The corpus pipeline: documents through the stages in STAGES, each written and read again.

Toxic documents go; one document of each near-duplicate group stays; contaminated documents go;
personal data gives way to the name of its kind; what is left is encoded. Each stage but the last
returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.bpe import encoded
from millrace.llm.common import stage, table
from millrace.llm.decontaminate import drop_contaminated
from millrace.llm.pii import redact
from millrace.llm.simhash import keep_one
from millrace.llm.toxicity import drop_toxic

STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", keep_one),
    ("decontamination", drop_contaminated),
    ("pii", redact),
    ("bpe", encoded),
]

ORACLE_SQL = None  # transducers, fingerprints and encodings are beyond SQL; see tests/llm/test_pipeline.py


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, name)
    return docs
