"""The corpus pipeline: quality, near-duplicates, repeated passages, benchmark leaks, then token ids.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which run() writes as Parquet and reads again as the next
stage's documents. All but the last give the columns of documents; each works on all that its predecessor kept.

Defined cases: null and empty texts, repeated rows, null ids and further columns are treated as the operators' docstrings
say; further columns of docs are carried through all stages, and come out of the last one beside the ids.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from brindle.llm import bpe, decontam, quality, sadedup, simhash  # noqa: E402
from brindle.llm.common import drop_path, drop_spent, spent_by, spread, table, written  # noqa: E402
from brindle.llm.queries import BYTE_BPE, PATTERN  # noqa: E402


def _columns(docs: DataFrame) -> list:
    return [docs[f"`{c}`"] for c in docs.columns]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (op 9) predicts as good."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group of similar texts (op 6): five-word shingles, similarity 0.8."""
    groups = simhash.similar_groups(docs, 5, 0.8)
    gone = groups.groupBy("doc_id").agg(F.bool_and(F.col("doc_id") != F.col("component_id")).alias("gone")).where("gone").select("doc_id")  # rows of one doc_id stay together
    gone = written(spark, gone, "duplicates")
    drop_path(spark, groups._brindle_path)
    return spent_by(docs.join(gone, "doc_id", "left_anti").select(*_columns(docs)), None, gone)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without long strings that an earlier document has (op 3); n_chars is counted anew."""
    out = sadedup.dedup(docs, 50, keep=tuple(c for c in docs.columns if c != "text"), with_text=True)
    row = {c: F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns}
    if "n_chars" in row:
        row["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(row["n_chars"])
    return spent_by(out.select(*(c.alias(name) for name, c in row.items())), out)


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no test item is leaked (op 10)."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of each text (op 1), with digests of the ids and of the bytes they decode to, and all columns of docs but
    text, which the ids decode to. A column that has the name of one of these gets an underscore."""
    out = bpe.encode(docs, BYTE_BPE, PATTERN, digests=True, ids=True, keep=tuple(docs.columns))
    taken = [c for c in out.columns if c != "row"]
    columns = [F.col(f"`{c}`") for c in taken]
    for c in docs.columns:
        if c not in ("doc_id", "text"):
            name = c
            while name in taken:
                name += "_"
            taken.append(name)
            columns.append(F.col(f"row.`{c}`").alias(name))
    return out.select(*columns)


STAGES = [("quality", quality_filter), ("near_duplicates", near_duplicate_filter), ("repeated_passages", repeated_passages), ("decontamination", benchmark_filter), ("token_ids", token_ids)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spread(table(spark, sf_dir, "documents")), None
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        docs = written(spark, out, f"pipeline-{name}")
        drop_spent(out)
        if before:
            drop_path(spark, before)
        before = docs._brindle_path
    return docs


#: SQL can express neither the classifier nor the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None
