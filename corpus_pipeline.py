"""From raw documents to training tokens, stage by stage.

Every stage works on all documents that the one before it kept. All but the
last return the columns of the documents they were given.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from qaprep.llm import decontaminate, queries, secrets, simhash
from qaprep.llm.common import write_table
from qaprep.session import ship_package

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that score below the accepted quality.

    NULL and empty texts are scored as texts without words; repeated rows get
    equal scores. A document without id is never learned from.
    """
    ship_package(spark)
    found = queries.scored(docs, queries.table(spark, sf_dir, "labels"))
    return found.where(F.col("score") >= queries.ACCEPTED).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group: a row that has the group's smallest id.

    A row is known by its id and fingerprint, so a copy goes even if its id also
    names another text. Of rows that are equal in both one stays. Texts without
    words, NULL or empty, are a group like any other. Rows without id cannot be
    told apart and stay. Columns of docs may have any name.
    """
    ship_package(spark)
    clash = {c: f"__{k}" for k, c in enumerate(docs.columns) if c.lower() in ("simhash", "component", "__n")}
    plain = docs.withColumnsRenamed(clash)
    printed = write_table(simhash.with_fingerprint(plain, shingle=4), "printed")
    found = simhash.grouped(printed.select(F.col("doc_id").alias("id"), "simhash"), distance=4)
    first = found.where(F.col("id") == F.col("component_id")).groupBy("id", "component")
    kept = first.agg(F.min("simhash").alias("simhash")).select(F.col("id").alias("doc_id"), "simhash").distinct()
    order = W.partitionBy("doc_id", "simhash").orderBy(F.xxhash64("text"))
    rows = printed.join(kept, ["doc_id", "simhash"], "left_semi").withColumn("__n", F.row_number().over(order))
    out = rows.where("__n = 1").unionByName(printed.where(F.col("doc_id").isNull()), allowMissingColumns=True)
    return out.select(*[F.col(clash.get(c, c)).alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that repeat a benchmark text.

    NULL and empty texts repeat none. Each row is decided by its own text, so
    repeated rows stay or go together.
    """
    ship_package(spark)
    found = decontaminate.with_leaks(docs, queries.table(spark, sf_dir, "benchmark"))
    return found.where(F.size("leaks") == 0).select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts; a changed text's n_chars follows.

    Rows without text or without secrets stay as they are, NULL as NULL.
    """
    ship_package(spark)
    model = secrets.fit(docs, path="source")
    found = secrets.scan(docs, model, path="source")
    out = {"text": F.col("redacted")}
    if "n_chars" in docs.columns:
        same = F.col("text").eqNullSafe(F.col("redacted"))
        length = F.length("redacted").cast(docs.schema["n_chars"].dataType)
        out["n_chars"] = F.when(same, F.col("n_chars")).otherwise(length)
    return found.select(*[out.get(c, F.col(c)).alias(c) for c in docs.columns])


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the tokens of each document and of the text they decode to.

    NULL and empty texts have no tokens and decode to an empty text. One row
    for each row of docs, repeated ones included.
    """
    ship_package(spark)
    return queries.token_digests(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secret_scan),
    ("encoding", encoding),
]

#: No SQL for the learned stages and for 64-bit fingerprints of whole texts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written and read again."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
