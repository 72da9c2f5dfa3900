"""A corpus from raw documents: toxic ones go, repeated lines and near copies go, benchmark leaks go, sources are mixed.

Each stage gets what the one before has kept, written as Parquet, and returns rows with the columns of its input; columns that are
named like an operator's results keep their own values. run() deletes the scratch tables of a stage once its result is written.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placeflow.llm._stage import delete, scratch, shared_dir, stage
from placeflow.llm.decontaminate import find_leaks
from placeflow.llm.jaccard import SMALL, jaccard_components
from placeflow.llm.line_dedup import dedup_lines
from placeflow.llm.mixing import mix_to_weights
from placeflow.llm.toxicity import learn_toxicity, score_toxicity


def _named(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def _apart(docs: DataFrame, names: tuple[str, ...], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What work keeps of docs, with docs' columns; those named like the results of an operator have other names meanwhile."""
    mark = uuid.uuid4().hex
    away = {c: f"{c}_{mark}" for c in docs.columns if c in names}
    inner = docs.withColumnsRenamed(away)
    return work(inner).select(*_named(inner)).withColumnsRenamed({v: k for k, v in away.items()})


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on those with labels, does not flag at their language's threshold.

    Null and empty texts are scored as one blank word, so they stay unless that is toxic; rows without doc_id are scored like
    others; repeated rows all get one decision, and all stay or go. An empty table gives an empty one.
    """
    model = learn_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _apart(docs, ("score", "predicted", "flagged"), lambda d: score_toxicity(d, model).where(~F.col("flagged")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many share; n_chars follows the text.

    The largest doc_id that holds such a line keeps it, in each of its rows if the id repeats. Null and empty texts, rows without
    doc_id and documents without such lines come back as they are; a text whose lines all go becomes empty. An empty table gives
    an empty one.
    """
    n_chars = F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return _apart(docs, ("n_lines", "n_dropped"), lambda d: dedup_lines(d).withColumn("n_chars", n_chars) if "n_chars" in d.columns else dedup_lines(d))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies; different rows of one doc_id are documents of their own.

    Texts without words link with nothing, so they stay; so do rows without doc_id, each of them. Equal rows with one doc_id are one
    document, of which one row stays. An empty table gives an empty one; other columns are kept whatever their names.
    """
    if not docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        return _keep_one_of_repeated_ids(docs)
    found = stage(jaccard_components(docs).where("doc_id IS NOT NULL").select("doc_id", "component_id"), "pipe-near")
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(F.broadcast(gone) if gone.count() <= SMALL else gone, "doc_id", "left_anti").select(*_named(docs))


def _keep_one_of_repeated_ids(docs: DataFrame) -> DataFrame:
    """The same where a doc_id repeats: equal rows are one document, and of near copies the first by doc_id and digests stays."""
    cells = [F.coalesce(F.sha2(F.col(f"`{c}`").cast("string").cast("binary"), 256), F.lit("-")) for c in ("text", *(c for c in docs.columns if c != "text"))]
    rows = docs.where("doc_id IS NOT NULL").withColumn("digest", F.concat(*cells))
    # numbers are fixed once written; which row has which one decides nothing
    keys = stage(rows.select("doc_id", "digest").distinct().withColumn("node", F.monotonically_increasing_id()), "pipe-nodes")
    numbered = stage(rows.join(keys, ["doc_id", "digest"]).dropDuplicates(["node"]), "pipe-rows")
    found = jaccard_components(numbered.select(F.col("node").alias("doc_id"), "text")).select(F.col("doc_id").alias("node"), "component_id")
    first = keys.join(found, "node").groupBy("component_id").agg(F.min(F.struct("doc_id", "digest", "node")).alias("s")).select("s.node")
    return numbered.join(first, "node", "left_semi").select(*_named(docs)).unionByName(docs.where("doc_id IS NULL"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs.

    Null and empty texts hold none and stay, as do all documents if benchmark is empty; blank items occur nowhere; repeated rows all
    stay or go. An empty table gives an empty one.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _apart(docs, ("leaks",), lambda d: find_leaks(d, benchmark).where(F.size("leaks") == 0))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with size, source_size, target, copies and taken, which replace columns of these names.

    Null and empty texts have size 0 and stay if their hash gives them a copy; a null source is a source of its own; rows that share
    a doc_id share a decision. An empty table gives an empty one.
    """
    return mix_to_weights(docs, whole_rows=True).where("copies > 0")


STAGES = [
    ("toxicity", keep_clean),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources to target weights", mix),
]

#: A trained network and edit distances have no SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, f) in enumerate(STAGES):
        with scratch() as made:
            f(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        delete(spark, made)
        docs = spark.read.parquet(f"{base}/{k}")
        if k:
            delete(spark, [f"{base}/{k - 1}"])
    return docs
