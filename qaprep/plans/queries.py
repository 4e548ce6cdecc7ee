"""The registered queries: every operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qaprep.functions import prompts, stem_rules, text
from qaprep.functions.lcs import lcs_len
from qaprep.functions.stem import stem_tokens
from qaprep.operators import align, batch, filters, oracle, runs, scoring, splits, vocab
from qaprep.plans import evaluate as evaluation
from qaprep.plans import tables
from qaprep.plans.curate import (
    CLEAN,
    CurateOptions,
    add_oracle,
    add_overlap,
    clean_rows,
    curate,
    curation_report,
)
from qaprep.plans.evaluate import evaluate, evaluate_rows, text_metrics, with_rouge
from qaprep.session import scratch_path
from qaprep.sources import readers, writers
from qaprep.streaming import evaluations

Query = Callable[[SparkSession, str], DataFrame]

BAR = "|"
PLACES = 6
VOCABULARY = 2000
ENCODED_WORDS = 128
PADDED_WORDS = 64
PATIENCE = 25
UNSTEMMED = CurateOptions(stem=False)
RAW_DDL = "row_id bigint, query string, title string, abstract string, label string"


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, PLACES) for c in columns})


def _joined(array: Column | str) -> Column:
    return F.array_join(F.transform(array, lambda x: x.cast("string")), BAR)


def _documents(expression: Callable[[Column], Column], name: str) -> Query:
    """A column function over the whole text of every document."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        documents = tables.table(spark, sf_dir, "documents")
        return documents.select("doc_id", expression(F.col("text")).alias(name))

    return query


def _sentences(column: Column) -> Column:
    return text.split_sentences(text.clean_text(column))


def _cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_rows(tables.raw_qa(spark, sf_dir))


def _overlapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_overlap(_cleaned(spark, sf_dir), UNSTEMMED)


# Text and sentence functions


def stem_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stem_rules.stem_vocabulary(tables.table(spark, sf_dir, "documents"))


def normalize_label(spark, sf_dir):
    raw = tables.raw_qa(spark, sf_dir)
    return raw.select("row_id", text.normalize_label(F.col("label")).alias("label"))


def word_count(spark, sf_dir):
    return _cleaned(spark, sf_dir).select("row_id", "label_tokens")


def append_end(spark, sf_dir):
    cleaned = _cleaned(spark, sf_dir)
    return cleaned.select("row_id", text.append_end(F.col("label")).alias("target_text"))


def overlap_ratio(spark, sf_dir):
    return _rounded(_overlapped(spark, sf_dir).select("row_id", "overlap"), "overlap")


def eligible_sentences(spark, sf_dir):
    sentences = _documents(_sentences, "sentences")(spark, sf_dir)
    kept = oracle.eligible_sentences(F.col("sentences"))
    return sentences.select("doc_id", F.inline(kept)).select("doc_id", "idx", "sent")


def oracle_reference(spark, sf_dir):
    cleaned = _cleaned(spark, sf_dir)
    query, label = F.col("query"), F.col("label")
    return cleaned.select(
        "row_id",
        *[
            oracle.oracle_reference(query, label, mode).alias(f"reference_{mode}")
            for mode in oracle.REFERENCE_MODES
        ],
    )


# Filters and curation


def filter_label_len(spark, sf_dir):
    rows = filters.filter_label_len(_cleaned(spark, sf_dir))
    return rows.select("row_id", "label", "label_tokens")


def _filter_overlap(scope: str) -> Query:
    def query(spark, sf_dir):
        rows = add_overlap(_cleaned(spark, sf_dir), CurateOptions(scope=scope))
        kept = filters.filter_overlap(rows).select("row_id", "label", "overlap")
        return _rounded(kept, "overlap")

    return query


def select_oracle(spark, sf_dir):
    scored = add_oracle(_overlapped(spark, sf_dir), UNSTEMMED)
    return _rounded(scored.select("row_id", "oracle_text", "oracle_rougeL"), "oracle_rougeL")


def filter_oracle(spark, sf_dir):
    scored = filters.filter_oracle(add_oracle(_overlapped(spark, sf_dir), UNSTEMMED))
    return _rounded(scored.select("row_id", "oracle_text", "oracle_rougeL"), "oracle_rougeL")


def drop_report(spark, sf_dir):
    return curation_report(tables.raw_qa(spark, sf_dir), UNSTEMMED)


def _curate(options: CurateOptions) -> Query:
    def query(spark, sf_dir):
        curated = curate(tables.raw_qa(spark, sf_dir), options, ("row_id",))
        return _rounded(curated, "overlap", "oracle_rougeL")

    return query


# Prompts


def _prompt(template: str) -> Query:
    def query(spark, sf_dir):
        raw = tables.raw_qa(spark, sf_dir)
        if template == "capitalized":
            names = ("query", "title", "abstract")
            raw = raw.withColumns(
                {
                    c: F.when(F.col(c).isNotNull(), text.clean_lower(F.col(c)))
                    for c in names
                }
            )
        if template == "inference":
            raw = raw.withColumn("context", F.col("abstract"))
        return prompts.render(raw, template).select("row_id", "input_text")

    return query


def prompt_summary(spark, sf_dir):
    summ = prompts.render(tables.summ_raw(spark, sf_dir), "summary")
    return summ.select("doc_id", "input_text", F.col("target").alias("target_text"))


def prompt_paraphrase(spark, sf_dir):
    rows = _cleaned(spark, sf_dir).withColumn("target_text", F.col("label"))
    return prompts.render(rows, "paraphrase").select("row_id", "input_text")


# Scores


def rouge_n(spark, sf_dir):
    scored = with_rouge(tables.predictions(spark, sf_dir), stem=False)
    return _rounded(scored.select("row_id", "rouge1", "rouge2"), "rouge1", "rouge2")


def lcs_length(spark, sf_dir):
    pairs = tables.predictions(spark, sf_dir)
    left, right = [text.rouge_tokens(F.col(c)) for c in ("predicted", "reference")]
    return pairs.select("row_id", lcs_len(left, right).alias("lcs"))


def rouge_l(spark, sf_dir):
    scored = with_rouge(tables.predictions(spark, sf_dir), stem=False)
    return _rounded(scored.select("row_id", "rougeL"), "rougeL")


def _bleu_counts(mode: str) -> Query:
    def query(spark, sf_dir):
        counted = scoring.with_bleu_counts(tables.predictions(spark, sf_dir), mode)
        return counted.select("row_id", "bleu_counts.*")

    return query


def _corpus_bleu(mode: str) -> Query:
    def query(spark, sf_dir):
        pairs = tables.predictions(spark, sf_dir)
        return _rounded(scoring.corpus_bleu(pairs, ["run"], mode), "bleu")

    return query


def sentence_bleu(spark, sf_dir):
    rows = evaluate_rows(tables.predictions(spark, sf_dir))
    return _rounded(rows.select("row_id", "bleu_score"), "bleu_score")


def exact_match(spark, sf_dir):
    pairs = tables.predictions(spark, sf_dir)
    return _rounded(scoring.exact_match(pairs, ["run"]), "exact_match")


def _metrics(by: tuple[str, ...], stem: bool) -> Query:
    def query(spark, sf_dir):
        metrics = text_metrics(tables.predictions(spark, sf_dir), by, stem=stem)
        return _rounded(metrics, "bleu", "rouge1", "rouge2", "rougeL")

    return query


def score_rows(spark, sf_dir):
    pairs = tables.predictions(spark, sf_dir).select("row_id", "run", "predicted", "reference")
    scored = evaluation.score_rows(pairs, stem=True).drop("predicted", "reference")
    return _rounded(scored, *evaluation.SCORES)


def evaluate_saved(spark, sf_dir):
    pairs = tables.predictions(spark, sf_dir)
    means = evaluation.evaluate_saved(pairs, scratch_path(spark, "scored"), ["run"], stem=False)
    return _rounded(means, "bleu", "rouge1", "rouge2", "rougeL", "exact_match")


def _evaluate(stem: bool) -> Query:
    def query(spark, sf_dir):
        report = evaluate(tables.predictions(spark, sf_dir), ["run"], stem)
        return _rounded(report, "bleu", "rouge1", "rouge2", "rougeL", "exact_match")

    return query


# Splits, samples, caps, alignment


def _split(mode: str) -> Query:
    def query(spark, sf_dir):
        documents = tables.table(spark, sf_dir, "documents").select("doc_id")
        return splits.split_dataset(documents, "doc_id", mode=mode)

    return query


def sample_review(spark, sf_dir):
    pairs = _cleaned(spark, sf_dir).select("row_id", "query", "label")
    return splits.sample_for_review(pairs)


def sample_sanity(spark, sf_dir):
    rows = splits.split_dataset(_cleaned(spark, sf_dir), "row_id")
    held_out = rows.filter(F.col("split") == "validation")
    return splits.sample_n(held_out, 3, "row_id").select("row_id", "label")


def cap_per_group(spark, sf_dir):
    rows = tables.summ_raw(spark, sf_dir).select("doc_id", "split")
    return splits.cap_per_group(rows, "split", 100, "doc_id")


def zip_pairs(spark, sf_dir):
    pairs = tables.predictions(spark, sf_dir)
    return align.zip_tables(
        pairs.select("row_id", "predicted"), pairs.select("row_id", "reference")
    )


def zip_by_position(spark, sf_dir):
    documents = tables.table(spark, sf_dir, "documents")
    rows = documents.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    sides = []
    for name in ("doc_id", "digest"):
        path = scratch_path(spark, name)
        rows.orderBy("doc_id", "digest").select(F.col(name).cast("string")).write.text(path)
        sides.append(readers.read_numbered_lines(spark, path))
    return align.zip_by_position(*sides, ("named", "digest"))


def append_column(spark, sf_dir):
    raw = tables.raw_qa(spark, sf_dir).select("row_id")
    scores = _rounded(evaluate_rows(tables.predictions(spark, sf_dir)), "bleu_score")
    return align.append_column(raw, scores, "bleu_score")


def stack_splits(spark, sf_dir):
    rows = tables.summ_raw(spark, sf_dir)
    parts = {
        split: rows.filter(F.col("split") == split).select("doc_id", "target")
        for split in splits.SPLITS
    }
    return readers.stack_splits(parts)


# Vocabulary, encoding, decoding


def _vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = tables.table(spark, sf_dir, "documents")
    return vocab.build_vocab(documents, "text", VOCABULARY)


def _written_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary, computed once."""
    path = scratch_path(spark, "vocabulary")
    writers.write_parquet(_vocabulary(spark, sf_dir), path)
    return spark.read.parquet(path)


def _encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = tables.table(spark, sf_dir, "documents").select("doc_id", "text")
    words = _written_vocabulary(spark, sf_dir)
    return vocab.encode(documents, "text", words, ENCODED_WORDS)


def _padded_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents, each filled up to the next multiple of PADDED_WORDS."""
    documents = tables.table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = vocab.encode(documents, "text", _written_vocabulary(spark, sf_dir), None)
    units = F.greatest(F.ceil(F.size("input_ids") / PADDED_WORDS), F.lit(1))
    sized = ids.withColumn("size", (units * PADDED_WORDS).cast("int"))
    padded = vocab.pad(sized, F.col("size"))
    labels = vocab.mask_labels(F.col("input_ids"), F.col("attention_mask"))
    return padded.withColumn("labels", labels)


def encode(spark, sf_dir):
    return _encoded(spark, sf_dir).select("doc_id", _joined("input_ids").alias("ids"))


def pad(spark, sf_dir):
    return vocab.pad(_encoded(spark, sf_dir), PADDED_WORDS).select(
        "doc_id", _joined("input_ids").alias("ids"), _joined("attention_mask").alias("mask")
    )


def mask_labels(spark, sf_dir):
    return _padded_whole(spark, sf_dir).select("doc_id", _joined("labels").alias("labels"))


def decode(spark, sf_dir):
    """Whole documents to ids and back."""
    documents = tables.table(spark, sf_dir, "documents").select("doc_id", "text")
    words = _written_vocabulary(spark, sf_dir)
    ids = vocab.encode(documents, "text", words, None)
    return vocab.decode(ids, words, VOCABULARY).select("doc_id", "text")


def encode_pairs(spark, sf_dir):
    rows = tables.curated_qa(spark, sf_dir).select("row_id", "input_text", "target_text")
    words = _written_vocabulary(spark, sf_dir)
    pairs = vocab.encode_pairs(rows, words, ENCODED_WORDS, PADDED_WORDS)
    return pairs.select(
        "row_id", *[_joined(c).alias(c) for c in ("input_ids", "attention_mask", "labels")]
    )


def argmax(spark, sf_dir):
    vectors = tables.table(spark, sf_dir, "embeddings")
    return vectors.select("vec_id", vocab.argmax(F.col("embedding")).alias("best"))


def validate_encoded(spark, sf_dir):
    return vocab.validate_encoded(_padded_whole(spark, sf_dir), F.col("size"))


# Run logs


def running_best(spark, sf_dir):
    best = runs.running_best(tables.eval_log(spark, sf_dir))
    return _rounded(best, "metric", "best_before")


def running_best_lower(spark, sf_dir):
    best = runs.running_best(tables.eval_log(spark, sf_dir), greater=False)
    return _rounded(best, "metric", "best_before")


def early_stop_stream(spark, sf_dir):
    """The evaluations as JSON files, read by a stream; the state at its end."""
    names = [scratch_path(spark, name) for name in ("evaluations", "status", "status-checkpoint")]
    log = tables.eval_log(spark, sf_dir)
    log.write.json(names[0])
    evaluations.early_stop_stream(spark, *names, PATIENCE).awaitTermination()
    last = evaluations.latest_status(spark.read.parquet(names[1])).drop("n_late")
    return _rounded(last.withColumn("run", F.col("run").cast(log.schema["run"].dataType)), "best_metric")


def early_stop(spark, sf_dir):
    return _rounded(runs.early_stop(tables.eval_log(spark, sf_dir), PATIENCE), "best_metric")


def best_checkpoint(spark, sf_dir):
    best = runs.best_checkpoint(tables.eval_log(spark, sf_dir), PATIENCE)
    return _rounded(best, "best_metric")


def step_profile(spark, sf_dir):
    return runs.step_profile(tables.train_log(spark, sf_dir))


def compare_runs(spark, sf_dir):
    table = runs.compare_runs(
        tables.long_metrics(spark, sf_dir), ("latency", "rougeL"), "config0_seed0"
    )
    return _rounded(table, "latency", "rougeL", "latency_ratio", "rougeL_ratio")


def seed_variance(spark, sf_dir):
    spread = runs.seed_variance(tables.long_metrics(spark, sf_dir))
    return _rounded(spread, "mean", "stddev", "min", "max")


def pareto(spark, sf_dir):
    front = runs.pareto(tables.run_metrics(spark, sf_dir))
    return _rounded(front, "latency", "rougeL")


def pareto_by_user_group(spark, sf_dir):
    events = tables.table(spark, sf_dir, "events").select(
        "event_id",
        "event_type",
        (F.col("user_id") % 100).cast("double").alias("latency"),
        F.col("value").alias("rougeL"),
    )
    return runs.pareto(events, ["event_type"])


def mean_loss(spark, sf_dir):
    epoch = F.floor(F.col("step") / 100).cast("bigint")
    log = tables.train_log(spark, sf_dir).withColumn("epoch", epoch)
    return _rounded(runs.mean_loss(log), "mean_loss")


def latency_summary(spark, sf_dir):
    events = tables.table(spark, sf_dir, "events").withColumnsRenamed(
        {"event_type": "run", "value": "latency"}
    )
    return _rounded(runs.latency_summary(events), "avg_latency")


def latency_percentiles(spark, sf_dir):
    events = tables.table(spark, sf_dir, "events").withColumnsRenamed(
        {"event_type": "run", "value": "latency"}
    )
    return _rounded(runs.latency_percentiles(events), "p50", "p95")


# Batch scoring


def first_sentence():
    """A stand-in model: answers with the first sentence of the input."""

    def predict(inputs: np.ndarray) -> np.ndarray:
        return np.array([str(x).split(". ")[0] for x in inputs])

    return predict


def length_scores():
    """A stand-in classifier over a premise and a hypothesis."""

    def predict(premises: np.ndarray, hypotheses: np.ndarray) -> np.ndarray:
        pairs = zip(premises, hypotheses, strict=True)
        rows = [[len(p) % 7, len(h) % 5, len(p) == len(h)] for p, h in pairs]
        return np.array(rows, dtype=np.float32)

    return predict


def batch_score(spark, sf_dir):
    rows = tables.raw_qa(spark, sf_dir).select(
        "row_id", text.clean_text(F.col("abstract")).alias("context")
    )
    scored = batch.batch_score(rows, ["context"], first_sentence)
    return scored.select("row_id", "prediction")


def augment(spark, sf_dir):
    rows = _cleaned(spark, sf_dir).select("row_id", F.col("label").alias("target_text"))
    return batch.augment(rows, first_sentence)


def score_pairs(spark, sf_dir):
    pairs = tables.predictions(spark, sf_dir).select("row_id", "predicted", "reference")
    scored = batch.score_pairs(pairs, length_scores)
    return scored.select("row_id", *batch.NLI_LABELS)


def scores_to_columns(spark, sf_dir):
    rows = tables.nli_raw(spark, sf_dir)
    return rows.select(
        "row_id",
        *[c.alias(n) for n, c in batch.scores_to_columns(F.col("scores")).items()],
    )


# Sources and sinks: each query writes a given table and reads it back


def _csv_round_trip(split: bool) -> Query:
    def query(spark, sf_dir):
        path = scratch_path(spark, "csv")
        writers.write_csv(tables.raw_qa(spark, sf_dir), path)
        back = readers.read_table_csv(spark, path, RAW_DDL, ("query", "label"), split=split)
        return back.select("row_id", "query", "title", "abstract", "label")

    return query


def with_defaults(spark, sf_dir):
    raw = tables.raw_qa(spark, sf_dir).select("row_id", "title")
    return readers.with_defaults(raw, {"title": "", "reference": "", "latency": 0.0})


def read_lines(spark, sf_dir):
    path = scratch_path(spark, "lines")
    tables.table(spark, sf_dir, "documents").select("text").write.text(path)
    lines = readers.read_lines(spark, path)
    return lines.groupBy("input").agg(F.count(F.lit(1)).alias("n"))


def jsonl_round_trip(spark, sf_dir):
    path = scratch_path(spark, "jsonl")
    rows = tables.summ_raw(spark, sf_dir)
    target = F.when(F.col("doc_id") % 7 != 0, F.col("target"))
    rows.select("source", target.alias("target")).write.json(path)
    return readers.read_summ_jsonl(spark, path)


def read_presplit(spark, sf_dir):
    path = scratch_path(spark, "presplit")
    rows = tables.summ_raw(spark, sf_dir).select("doc_id", "target", "split")
    writers.write_parquet(rows, f"{path}/all", ["split"])
    paths = {split: f"{path}/{split}" for split in splits.SPLITS}
    for split, target in paths.items():
        part = spark.read.parquet(f"{path}/all").filter(F.col("split") == split)
        writers.write_csv(part.drop("split"), target)
    return readers.read_presplit(spark, paths, "doc_id bigint, target string")


def read_run_metrics(spark, sf_dir):
    return _run_metrics(spark, sf_dir, ("accuracy", "speed"), "absent")


def read_run_metrics_named(spark, sf_dir):
    return _run_metrics(spark, sf_dir, ("accuracy +1 [a]", "speed 50%20"), "absent%")


def _run_metrics(spark: SparkSession, sf_dir: str, kinds: tuple[str, str], absent: str) -> DataFrame:
    path = scratch_path(spark, "runs")
    metrics = tables.run_metrics(spark, sf_dir)
    for kind, column in zip(kinds, ("rougeL", "latency"), strict=True):
        summary = metrics.agg(F.max(column).alias("best"), F.avg(column).alias("mean"))
        line = summary.select(F.to_json(F.struct("best", "mean")).alias("value"))
        _write_single(spark, line, f"{path}/{kind}", readers.METRICS_FILE)
    folders = [f"{path}/{k}" for k in (*kinds, absent)]
    found = readers.read_run_metrics(spark, folders)
    named = found.withColumn("run", F.regexp_extract("run", "([^/]+)$", 1))
    return _rounded(named, "value")


def _write_single(spark: SparkSession, line: DataFrame, folder: str, name: str) -> None:
    """Write a one-row text as one named file, as a trainer would."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    system = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = system.create(hadoop_path)
    stream.write(bytearray(line.first()["value"], "utf-8"))
    stream.close()


def load_pairs_raw(spark, sf_dir):
    raw = tables.raw_qa(spark, sf_dir)
    return readers.load_pairs(raw, ("query", "title", "abstract"), "label")


def load_pairs_ready(spark, sf_dir):
    curated = tables.curated_qa(spark, sf_dir)
    return readers.load_pairs(curated, ("query",), "label")


def require_columns(spark, sf_dir):
    raw = tables.raw_qa(spark, sf_dir)
    return raw.select("row_id", *readers.require_columns(raw, ("query", "label")))


def path_filter(spark, sf_dir):
    path = scratch_path(spark, "named")
    rows = tables.summ_raw(spark, sf_dir).select("target")
    rows.write.json(f"{path}/abstract")
    writers.write_csv(rows, f"{path}/other")
    return readers.read_summ_jsonl(spark, path, readers.name_glob("part-", ".JSON"))


def files_in_path(spark, sf_dir):
    """Rows of the files in folders whose names only differ in a special character."""
    path = scratch_path(spark, "folders")
    rows = tables.table(spark, sf_dir, "documents").select("doc_id")
    names = ("a+b", "a b", "a%20b")
    for k, name in enumerate(names):
        rows.where(F.col("doc_id") % 3 == k).write.json(f"{path}/{name}")
    found = [
        readers.in_path(spark.read.schema("doc_id long").json([f"{path}/{n}" for n in names]), f"/{part}/")
        .select(F.lit(part).alias("part"), "doc_id")
        for part in ("A+b", "a b", "a%20B")
    ]
    return found[0].unionByName(found[1]).unionByName(found[2])


def jsonl_by_step(spark, sf_dir):
    path = scratch_path(spark, "steps")
    pairs = tables.predictions(spark, sf_dir)
    step = (F.col("row_id") % 3).cast("int")
    rows = pairs.select("row_id", "predicted", "reference", step.alias("step"))
    writers.write_jsonl(rows, path, "step")
    ddl = "row_id bigint, predicted string, reference string, step int"
    return spark.read.schema(ddl).json(path)


def metrics_round_trip(spark, sf_dir):
    path = scratch_path(spark, "metrics")
    writers.write_metrics(tables.run_metrics(spark, sf_dir), path)
    back = spark.read.schema("run int, latency double, rougeL double").json(path)
    return _rounded(back, "latency", "rougeL")


def parquet_round_trip(spark, sf_dir):
    path = scratch_path(spark, "parquet")
    rows = tables.summ_raw(spark, sf_dir)
    writers.write_parquet(rows, path, ["split"])
    return spark.read.parquet(path).select("doc_id", "target", "split")


def metrics_log_repeated(spark, sf_dir):
    path = scratch_path(spark, "log")
    metrics = tables.run_metrics(spark, sf_dir)
    named = metrics.select(F.concat(F.lit("run"), F.col("run").cast("string")).alias("run"), "latency", "rougeL")
    for commit in ("first", "second", "first"):
        part = F.col("run").endswith("1") if commit == "first" else ~F.col("run").endswith("1")
        writers.append_metrics(named.filter(part), path, commit)
    return _rounded(writers.read_metrics_log(spark, path), "value")


def metrics_log(spark, sf_dir):
    path = scratch_path(spark, "log")
    metrics = tables.run_metrics(spark, sf_dir)
    run = F.concat(F.lit("run"), F.col("run").cast("string"))
    even = metrics.filter(F.col("run") % 2 == 0).select(run.alias("run"), "latency", "rougeL")
    odd = metrics.filter(F.col("run") % 2 == 1).select(run.alias("run"), "rougeL")
    writers.append_metrics(even, path)
    writers.append_metrics(odd, path)
    log = writers.read_metrics_log(spark, path)
    return _rounded(runs.compare_runs(log, ("latency", "rougeL")), "latency", "rougeL")


QUERIES: dict[str, Query] = {
    "clean_text": _documents(text.clean_text, "cleaned"),
    "clean_lower": _documents(text.clean_lower, "cleaned"),
    "clean_punct": _documents(text.clean_punct, "cleaned"),
    "normalize_label": normalize_label,
    "word_count": word_count,
    "append_end": append_end,
    "word_tokens": _documents(lambda c: _joined(text.word_tokens(c)), "tokens"),
    "rouge_tokens": _documents(lambda c: _joined(text.rouge_tokens(c)), "tokens"),
    "stem_tokens": _documents(
        lambda c: F.array_join(stem_tokens(text.rouge_tokens(c)), BAR), "tokens"
    ),
    "stem_vocabulary": stem_vocabulary,
    "bleu_tokens_ws": _documents(lambda c: _joined(text.bleu_tokens(c, "ws")), "tokens"),
    "bleu_tokens_13a": _documents(lambda c: _joined(text.bleu_tokens(c)), "tokens"),
    "split_sentences": _documents(lambda c: F.array_join(_sentences(c), "\n"), "sentences"),
    "trim_sentences": _documents(lambda c: text.trim_sentences(_sentences(c)), "trimmed"),
    "to_bullets": _documents(lambda c: text.to_bullets(_sentences(c)), "bullets"),
    "token_set": _documents(
        lambda c: _joined(F.sort_array(text.token_set(c))), "tokens"
    ),
    "overlap_ratio": overlap_ratio,
    "eligible_sentences": eligible_sentences,
    "ngrams_2": _documents(
        lambda c: _joined(text.ngrams(text.rouge_tokens(c), 2)), "grams"
    ),
    "filter_label_len": filter_label_len,
    "filter_overlap_trimmed": _filter_overlap("trimmed"),
    "filter_overlap_full": _filter_overlap("full"),
    "filter_oracle": filter_oracle,
    "drop_report": drop_report,
    "curate": _curate(UNSTEMMED),
    "curate_stemmed": _curate(CLEAN),
    "curate_end_token": _curate(CurateOptions(stem=False, end_token="[END]")),
    "curate_variant_oracle": _curate(
        CurateOptions(stem=False, scope="full", score_filter=False)
    ),
    "curate_variant_label": _curate(
        CurateOptions(stem=False, scope="full", score_filter=False, target_style="label")
    ),
    "curate_variant_bullets": _curate(
        CurateOptions(stem=False, scope="full", score_filter=False, target_style="bullets")
    ),
    "oracle_reference": oracle_reference,
    "select_oracle": select_oracle,
    "rouge_n": rouge_n,
    "lcs_length": lcs_length,
    "rouge_l": rouge_l,
    "bleu_counts_ws": _bleu_counts("ws"),
    "bleu_counts_13a": _bleu_counts("13a"),
    "corpus_bleu_ws": _corpus_bleu("ws"),
    "corpus_bleu_13a": _corpus_bleu("13a"),
    "sentence_bleu": sentence_bleu,
    "exact_match": exact_match,
    "prompt_answer": _prompt("answer"),
    "prompt_columns": _prompt("columns"),
    "prompt_capitalized": _prompt("capitalized"),
    "prompt_inference": _prompt("inference"),
    "prompt_training": _prompt("training"),
    "prompt_summary": prompt_summary,
    "prompt_paraphrase": prompt_paraphrase,
    "split_hash": _split("hash"),
    "split_exact": _split("exact"),
    "split_floor": _split("floor"),
    "sample_review": sample_review,
    "sample_sanity": sample_sanity,
    "cap_per_group": cap_per_group,
    "build_vocab": _vocabulary,
    "encode": encode,
    "encode_pairs": encode_pairs,
    "pad": pad,
    "mask_labels": mask_labels,
    "decode": decode,
    "argmax": argmax,
    "validate_encoded": validate_encoded,
    "text_metrics": _metrics(("run",), stem=False),
    "text_metrics_total": _metrics((), stem=False),
    "text_metrics_stemmed": _metrics(("run",), stem=True),
    "evaluate": _evaluate(stem=False),
    "score_rows": score_rows,
    "evaluate_saved": evaluate_saved,
    "evaluate_stemmed": _evaluate(stem=True),
    "mean_loss": mean_loss,
    "latency_summary": latency_summary,
    "latency_percentiles": latency_percentiles,
    "running_best": running_best,
    "running_best_lower": running_best_lower,
    "early_stop": early_stop,
    "early_stop_stream": early_stop_stream,
    "best_checkpoint": best_checkpoint,
    "step_profile": step_profile,
    "compare_runs": compare_runs,
    "seed_variance": seed_variance,
    "pareto": pareto,
    "pareto_by_group": pareto_by_user_group,
    "zip_pairs": zip_pairs,
    "zip_by_position": zip_by_position,
    "append_column": append_column,
    "stack_splits": stack_splits,
    "batch_score": batch_score,
    "augment": augment,
    "score_pairs": score_pairs,
    "scores_to_columns": scores_to_columns,
    "csv_round_trip": _csv_round_trip(split=False),
    "csv_split_round_trip": _csv_round_trip(split=True),
    "with_defaults": with_defaults,
    "read_lines": read_lines,
    "jsonl_round_trip": jsonl_round_trip,
    "read_presplit": read_presplit,
    "read_run_metrics": read_run_metrics,
    "read_run_metrics_named": read_run_metrics_named,
    "files_in_path": files_in_path,
    "load_pairs_raw": load_pairs_raw,
    "load_pairs_ready": load_pairs_ready,
    "require_columns": require_columns,
    "path_filter": path_filter,
    "jsonl_by_step": jsonl_by_step,
    "metrics_round_trip": metrics_round_trip,
    "parquet_round_trip": parquet_round_trip,
    "metrics_log": metrics_log,
    "metrics_log_repeated": metrics_log_repeated,
}
