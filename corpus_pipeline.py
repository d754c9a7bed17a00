"""A corpus pipeline of five stages: rules, line dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes each
stage's result as Parquet to the folder the cluster shares and reads it for the next, so
that an executor that is lost costs the stage at hand only.
"""

from __future__ import annotations

import uuid

from locusframe.llm import decontam, lines, mixing, rules, simhash
from locusframe.llm.common import BLANKS, shared_dir
from pyspark.sql import functions as F

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark, docs, sf_dir):
    """Drops the documents that the rules' policy rejects.

    Rows are judged one by one: null and empty texts have no words and go, repeated
    rows share their fate, null ids stay; an empty table stays empty.
    """
    return rules.keep_good(docs).select(*COLUMNS)


def line_dedup(spark, docs, sf_dir):
    """Cuts later copies of repeated line runs; what a cut leaves without a word goes.

    Of rows with equal id and text none is a copy of the other; null ids come first;
    null and blank texts have no lines with words and stay; an empty table stays empty.
    """
    out = lines.dedup_lines(docs)
    emptied = (F.col("n_removed_lines") > 0) & (F.length(F.translate("text", BLANKS, "")) == 0)
    out = out.where(~F.coalesce(emptied, F.lit(False)))
    return out.withColumn("n_chars", F.when(F.col("n_removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_dedup(spark, docs, sf_dir):
    """Keeps one document of each group of near-copies.

    A document that line dedup cut is judged by the text it had, too: what is left of a
    near-copy, once the lines it shares are gone, resembles nothing any more. Blank and
    null texts are near-copies of each other; ties go by id, then by text; an empty
    table stays empty.
    """
    return simhash.drop_near_duplicates(docs, originals=spark.read.parquet(f"{sf_dir}/documents.parquet")).select(*COLUMNS)


def decontaminate(spark, docs, sf_dir):
    """Drops the documents that contain a benchmark item.

    Null and empty texts contain nothing; repeated rows go together; without items or
    documents nothing changes.
    """
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def mix(spark, docs, sf_dir):
    """How many words of each document the mix takes; a row per row, null sources are one source."""
    return mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("quality rules", quality),
    ("line dedup", line_dedup),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing", mix),
]

#: The stages are not expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages applied to the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            _delete(spark, f"{folder}/{i - 1}")
    out = STAGES[-1][1](spark, docs, sf_dir)
    _delete(spark, folder)  # the mix reads its checkpoints only
    return out


def _delete(spark, folder):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
