"""The corpus pipeline: documents in a known language, without near copies, benchmark passages and secrets, as token ids.

Each stage is written as Parquet to a folder of the run in ``spark.checkpoint.dir`` and read again as the next one's
input; a stage's folder is removed once the next one is written. Without that setting a local session uses a temporary
folder, and a cluster is refused.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from seamcover.functions.graph import shared_folder
from seamcover.llm.decontamination import decontamination_stage
from seamcover.llm.language import language_stage
from seamcover.llm.pieces import encoding_stage
from seamcover.llm.secrets import redaction_stage
from seamcover.llm.simhash import dedup_stage

STAGES = [
    ("language_id", language_stage),
    ("simhash_dedup", dedup_stage),
    ("decontamination", decontamination_stage),
    ("secret_redaction", redaction_stage),
    ("sentencepiece", encoding_stage),
]

#: None: code lengths, 64-bit XXH64 fingerprints and merge-ranked pieces aren't expressible in SQL; a test holds the rows
#: against plain loops, with the learned trees and the library's ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table documents of ``sf_dir``."""
    root = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (name, stage) in enumerate(STAGES):
        path = f"{root}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            _remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
