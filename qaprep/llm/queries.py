"""Registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qaprep.functions.bind import bind
from qaprep.llm import (
    bpe, decontaminate, jaccard, langid, periodic, pii, quality, rules, secrets, simhash, spelling,
    substrings, warc,
)
from qaprep.llm.common import SPACES, held_out

#: The vocabulary file among the public tokenizers.
VOCABULARY = "byte_bpe_50k.json"
ACCEPTED = 0.3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    return public_tokenizers.path(VOCABULARY)


def hexadecimal(number: str):
    """A signed 64-bit number as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(number), 16, "0"))


def token_digests(documents: DataFrame) -> DataFrame:
    coded = bpe.encode_decode(documents.select("doc_id", "text"), tokenizer_path())
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, distance=4)
    return found.select("doc_id", hexadecimal("simhash").alias("fingerprint"), "component_id")


def scored(documents: DataFrame, labels: DataFrame) -> DataFrame:
    model = quality.fit(documents, labels, ~held_out("doc_id", 5, 0))
    return quality.score(documents, model)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(documents, table(spark, sf_dir, "labels")).select(
        "doc_id",
        held_out("doc_id", 5, 0).alias("held_out"),
        "score",
        (F.col("score") >= ACCEPTED).cast("int").alias("predicted"),
    )


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = langid.fit(documents, ~held_out("doc_id", 3, 1))
    return langid.identify(documents.select("doc_id", "text"), model).select(
        "doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score", "ambiguous"
    )


def op5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return rules.apply_rules(documents, keep_text=False).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"),
    )


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    model = secrets.fit(documents, path="source")
    found = secrets.scan(documents, model, path="source")
    return found.select("doc_id", F.inline("findings")).select(
        "doc_id", "start", "end", "secret", F.round("probability", 6).alias("probability")
    )


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.with_leaks(documents, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.inline("leaks"))


def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.duplicate_passages(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.sanitise(table(spark, sf_dir, "documents"))
    base = {k: F.col(k) for k in pii.KINDS}
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(pii.joined(base), 256).alias("base_sha256"),
        pii.joined(base | {k: F.col(k) for k in ("generalise", "remove")}).alias("spans"),
        # Texts without spans stay as they are and have no digest here.
        F.sha2(F.col("sanitised").cast("binary"), 256).alias("sanitised_sha256"),
    )


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.derive(warc.responses(table(spark, sf_dir, "pages")))
    written = records.withColumn("record_digest", warc.digest(warc.record_text()))
    return written.withColumnRenamed("source_id", "page_id")


def op11_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, sf_dir, "documents"), shingle=4, percent=85)


def with_planted_runs(documents: DataFrame) -> DataFrame:
    """The documents; those whose hash is a multiple of 10 repeat a stretch of words.

    A document without id or text stays as it is.
    """
    number = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.array_remove(F.split("text", f"{SPACES}+"), "")

    def repeated(found):
        tens = F.floor(number / 10)
        n = F.size(found["words"])
        first = (tens % n).cast("int")
        period = (1 + F.floor((n - first) / (3 + tens % 8))).cast("int")
        # Evaluated once for all words of a document.
        bounds = F.struct(first.alias("first"), period.alias("period"))
        return bind(
            bounds,
            lambda b: F.transform(
                found["words"],
                lambda w, i: F.when(i < b["first"], w).otherwise(
                    F.get(found["words"], b["first"] + (i - b["first"]) % b["period"])
                ),
            ),
        )

    planted = bind(
        F.struct(words.alias("words")),
        lambda found: F.when(F.size(found["words"]) > 0, F.array_join(repeated(found), " ")).otherwise(""),
    )
    changed = (number % 10 == 0) & F.col("text").isNotNull()
    return documents.withColumn("text", F.when(changed, planted).otherwise(F.col("text")))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic.with_runs(documents).select("doc_id", "runs", "collapsed")
    # The greatest length first, then the smallest start and period.
    ranked = F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))
    best = F.array_min(ranked)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.s").alias("start"),
        (-F.col("best.l")).alias("length"),
        F.col("best.p").alias("period"),
        F.floor(-1000 * F.col("best.l") / F.col("best.p")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    words = spelling.count_words(documents, "text", "doc_id", spelling.drop_letter)
    return spelling.variants(words.where((F.length("word") >= 5) & (F.col("n") >= 3)))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_simhash": op2_simhash,
    "op3_quality": op3_quality,
    "op4_language": op4_language,
    "op5_rules": op5_rules,
    "op6_secrets": op6_secrets,
    "op7_decontaminate": op7_decontaminate,
    "op8_passages": op8_passages,
    "op9_pii": op9_pii,
    "op10_warc": op10_warc,
    "op11_jaccard": op11_jaccard,
    "op12_runs": op12_runs,
    "op13_spelling": op13_spelling,
    "pipeline": pipeline,
}
