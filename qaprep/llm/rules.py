"""Quality rules with adaptive thresholds.

Counts of each document are turned into rates. For every language and source a
mergeable quantile sketch holds how the rates are spread: a count for each
bucket of a scale whose buckets are 1/32 of their value wide at most. Sketches
are added bucket by bucket, so those of a language, or of the whole corpus, are
sums of the smaller ones. A language's sketch is blended with a few documents
spread like the corpus, and a source's with a few spread like its language, so
that fences of small groups change smoothly as documents are added. A document
is kept if no rate lies beyond its group's fences.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from qaprep.llm.common import append_columns, text_bytes, without, write_table

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_upper")
#: As many documents of the wider group are blended into a group's sketch.
BLENDED = 10
#: Parts that a document is counted in when sketches are blended.
PARTS = 1000
#: Distances of a quantile from the median that a fence lies beyond the quantile.
REACH = 3
#: So many words, lines or characters too many, or too few, break no rule yet.
SPARED = 3
#: Whether low values count too, and the quantile, in hundredths, whose distance
#: from the median makes the fence. It tells how common a trait may be in a
#: group before it is usual there: symbols in a quarter of all documents, odd
#: lengths in a twentieth, the others in a hundredth.
RATES = {
    "symbol_rate": (False, 75),
    "dup_line_rate": (False, 99),
    "repeat_rate": (False, 99),
    "mark_rate": (False, 99),
    "upper_rate": (False, 99),
    "word_length": (True, 95),
}
#: Count, what it is divided by, and the unit: thousandths, or hundredths.
SHARES = {
    "symbol_rate": ("n_symbols", "word_chars", 1000),
    "dup_line_rate": ("n_dup_lines", "n_lines", 1000),
    "repeat_rate": ("n_repeat_words", "n_words", 1000),
    "mark_rate": ("n_marks", "n_words", 1000),
    "upper_rate": ("n_upper", "word_chars", 1000),
    "word_length": ("word_chars", "n_words", 100),
}


def repeat_words(words: list[bytes], joined: bytes, ends: np.ndarray) -> int:
    """Words inside windows of WINDOW words that occur twice or more."""
    n = len(words)
    if n <= WINDOW:
        return 0
    starts = [0, *ends[:-WINDOW].tolist()]
    windows = [joined[s:e] for s, e in zip(starts, ends[WINDOW - 1 :].tolist())]
    if len(set(windows)) == len(windows):
        return 0
    seen: dict[bytes, int] = {}
    again = np.zeros(n + 1, np.int64)
    first = [seen.setdefault(w, i) for i, w in enumerate(windows)]
    later = np.flatnonzero(np.array(first) != np.arange(len(first)))
    starts_at = np.union1d(later, np.array(first)[later])
    np.add.at(again, starts_at, 1)
    np.add.at(again, starts_at + WINDOW, -1)
    return int((np.cumsum(again[:-1]) > 0).sum())


def count(text: bytes) -> tuple[int, ...]:
    """The COUNTS of one text."""
    words = text.split()
    joined = b" ".join(words) + b" "
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    octets = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    in_words = int(octets.sum() - octets[128:192].sum() - octets[9:14].sum() - octets[32])
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words),
        in_words,
        int(octets[list(SYMBOLS)].sum()),
        len(lines) - len(set(lines)),
        repeat_words(words, joined, ends),
        len(lines),
        int(octets[33] + octets[63]),
        int(octets[65:91].sum()),
    )


def with_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """df with COUNTS as long columns; NULL text has no words."""

    def make():
        def compute(texts: pa.Array) -> list:
            rows = np.array([count(t) for t in text_bytes(texts)], np.int64).reshape(-1, len(COUNTS))
            return [pa.array(np.ascontiguousarray(rows[:, i])) for i in range(len(COUNTS))]

        return compute

    return append_columns(df, text, [T.StructField(c, T.LongType()) for c in COUNTS], make)


def rates() -> dict[str, Column]:
    """Rates in whole thousandths (hundredths for the length of words)."""
    return {
        rate: F.floor(unit * F.col(part) / F.greatest(F.col(whole), F.lit(1)))
        for rate, (part, whole, unit) in SHARES.items()
    }


def bucket(value: Column) -> Column:
    """Lower end of a value's bucket: exact to 64, then six leading bits."""
    step = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    unit = F.pow(F.lit(2.0), step).cast("long")
    return (F.floor(value / unit) * unit).cast("long")


def sketches(counted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rate, bucket, n): one sketch for each group and rate."""
    named = rates()
    pairs = F.array(*[F.struct(F.lit(k).alias("rate"), bucket(v).alias("bucket")) for k, v in named.items()])
    return (
        counted.select(*keys, F.inline(pairs)).groupBy(*keys, "rate", "bucket").agg(F.count("*").alias("n"))
    )


def merged(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """The sum of sketches over fewer keys."""
    return sketch.groupBy(*keys, "rate", "bucket").agg(F.sum("n").alias("n"))


def spread_like(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rate, bucket, n): BLENDED documents, in PARTS, spread like a sketch."""
    by = W.partitionBy(*keys, "rate")
    upto, total = F.sum("n").over(by.orderBy("bucket")), F.sum("n").over(by)
    part = lambda n: F.floor(n * F.lit(BLENDED * PARTS) / F.col("total"))
    summed = sketch.select(*keys, "rate", "bucket", "n", upto.alias("upto"), total.alias("total"))
    return summed.select(*keys, "rate", "bucket", (part(F.col("upto")) - part(F.col("upto") - F.col("n"))).alias("n"))


def blended(sketch: DataFrame, keys: list[str], wider: DataFrame, shared: list[str]) -> DataFrame:
    """Sketches of groups, in PARTS of documents, with some of the wider group's.

    Each group of `keys` lies in one group of `shared`, whose documents come
    from `spread_like`.
    """
    groups = sketch.select(*keys, "rate").distinct()
    named = wider.withColumnsRenamed({c: f"w_{c}" for c in [*shared, "rate"]})
    same = [F.col(c).eqNullSafe(F.col(f"w_{c}")) for c in [*shared, "rate"]]
    more = groups.join(named, same).select(*keys, "rate", "bucket", "n")
    own = sketch.select(*keys, "rate", "bucket", (F.col("n") * PARTS).alias("n"))
    return merged(own.union(more), keys)


def fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ends): a map from rate to lowest and highest value."""
    by = W.partitionBy(*keys, "rate")
    ranked = sketch.select(
        *keys, "rate", "bucket",
        F.sum("n").over(by.orderBy("bucket")).alias("upto"),
        F.sum("n").over(by).alias("total"),
    )
    level = F.create_map(*[F.lit(x) for k, (_, q) in RATES.items() for x in (k, q)])[F.col("rate")]
    at = lambda share: F.min(F.when(F.col("upto") * 100 >= F.col("total") * share, F.col("bucket")))
    quantiles = ranked.groupBy(*keys, "rate").agg(
        at(100 - level).alias("few"), at(F.lit(50)).alias("middle"), at(level).alias("many")
    )
    ends = F.struct(
        (F.col("few") - REACH * (F.col("middle") - F.col("few"))).alias("low"),
        (F.col("many") + REACH * (F.col("many") - F.col("middle"))).alias("high"),
    )
    return quantiles.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rate", ends))).alias("ends"))


def group_fences(counted: DataFrame) -> DataFrame:
    """(g_lang, g_source, ends) from rows of COUNTS, g_lang and g_source."""
    own = write_table(sketches(counted, ["g_lang", "g_source"]), "sketches")
    by_lang = merged(own, ["g_lang"])
    corpus = spread_like(merged(by_lang, []), [])
    tongue = write_table(spread_like(blended(by_lang, ["g_lang"], corpus, []), ["g_lang"]), "tongues")
    return fences(blended(own, ["g_lang", "g_source"], tongue, ["g_lang"]), ["g_lang", "g_source"])


def broken_rules(ends: Column) -> Column:
    """Names of the rates that lie beyond their fences by more than SPARED counts."""
    names = []
    for rate, (part, whole, unit) in SHARES.items():
        size = F.greatest(F.col(whole), F.lit(1))
        out = unit * (F.col(part) - SPARED) > ends[rate]["high"] * size
        if RATES[rate][0]:
            out = out | (unit * (F.col(part) + SPARED) < ends[rate]["low"] * size)
        names.append(F.when(out, F.lit(rate)))
    return F.array_compact(F.array(*names))


def apply_rules(
    df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", keep_text: bool = True
) -> DataFrame:
    """df with COUNTS, `base_failed`, `failed_rules` (array of names) and `kept`.

    Fences come from all rows of df that pass the base rules. NULL languages
    and NULL sources are groups of their own; NULL and empty texts fail the
    base rules. Repeated rows count each time and get equal results. Columns of
    the new names are replaced. Without `keep_text` the text column is left out
    and the texts are read only once.
    """
    given = without(df, [*COUNTS, "base_failed", "failed_rules", "kept"])
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = with_counts(given, text)
    if not keep_text:
        rows = write_table(rows.drop(text), "counts")
    counted = rows.select(F.col(lang).alias("g_lang"), F.col(source).alias("g_source"), *COUNTS)
    table = write_table(group_fences(counted.where(~failed)), "fences")
    if table.count() <= 20_000:  # groups of language and source
        table = F.broadcast(table)
    joined = rows.join(
        table,
        rows[lang].eqNullSafe(table["g_lang"]) & rows[source].eqNullSafe(table["g_source"]),
        "left",
    )
    return joined.select(
        *rows.columns,
        failed.alias("base_failed"),
        broken_rules(F.col("ends")).alias("failed_rules"),
    ).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
