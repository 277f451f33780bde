"""A training-data pipeline over documents: each stage works on what its predecessor kept.

Every stage takes null and empty texts, repeated rows, empty tables and further
columns of any name; those of a stage's own output are replaced as its docstring says.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import bpe, exact_dedup, mixing, ngram_join, toxicity
from panelforge.llm.common import read_table, unused
from panelforge.llm.queries import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.5; a null text is judged like an empty one."""
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    score = unused("score", docs.columns)
    return toxicity.score(docs, model, score_col=score).filter(F.col(score) < 0.5).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked documents the row with the smallest doc_id."""
    return ngram_join.representatives(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those that it doesn't take go."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with token_ids, their number n_tokens, and decoded, the text that decoding them gives.

    Columns of these three names are replaced.
    """
    return bpe.encode(docs, vocabulary(), decoded_col="decoded").withColumn("n_tokens", F.size("token_ids").cast("long"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard", drop_near_copies),
    ("source_mix", mix),
    ("bpe", encode),
]

#: The first, third and last stage are learned or tokenized: SQL can't express them. Tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written as Parquet in the shared folder and read again."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="panelforge-pipeline-")
    folder = f"{shared}/pipeline-{spark.sparkContext.applicationId}-{spark.range(1).select(F.uuid()).first()[0]}"
    docs = read_table(spark, sf_dir, "documents")
    before = None
    for i, (name, stage) in enumerate(STAGES):
        after = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(after)
        docs = spark.read.parquet(after)
        if before:  # what the next stage has read is not needed again
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = after
    return docs
