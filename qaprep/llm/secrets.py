"""Secret scans with a random forest that removes false positives.

Runs of key-like characters are candidates. What describes one: its length and
characters, how surprising its character transitions are for the corpus, how
much of it is dictionary words, whether it is part of a path, and what stands
around it. A random forest (MLlib) learns from labelled findings which
candidates are secrets; its trees go with the tasks, so a scan is row-local.

The transition counts are sums over all documents. The dictionary holds the
heavy hitters of all words: those with at least one `DICTIONARY`th of all
occurrences, which bounds its size. Every word is counted; tasks send sums.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qaprep.llm.common import append_columns, slices, text_bytes, write_table
from qaprep.session import scratch_path

#: A word of the dictionary has at least one part in so many of all occurrences.
DICTIONARY = 4_096
#: Distinct words, and bytes of text, whose counts a task holds before it sends them.
COUNTED_WORDS, COUNTED_BYTES = 200_000, 64 << 20
#: Labelled findings that the forest is fitted on at most, chosen by hash.
LABELLED_FINDINGS = 20_000
TREES, DEPTH, SEED = 24, 6, 29
THRESHOLD = 0.5
PLACEHOLDER = "[SECRET]"

CANDIDATE = re.compile(rb"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{12,}={0,2}")
# Names that secrets are assigned to, prefixes that issuers give
# keys, and words that mark examples.
NAMES = re.compile(
    rb"(?i)(token|secret|passw(?:or)?d|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|credential)s?"
    rb"[\"']?\s*(?:[:=]|=>|is)?\s*[\"']?$"
)
ISSUED = re.compile(rb"^(AKIA|ASIA|ghp_|gho_|github_pat_|xox[abprs]-|sk_live_|rk_live_|AIza|eyJ)")
EXAMPLES = re.compile(rb"(?i)example|sample|dummy|placeholder|test|fixture|changeme|your[_-]")
NEAR = 48

FIELDS = (
    "length", "log_length", "digits", "upper", "lower", "other", "changes", "surprise",
    "entropy", "coverage", "hex", "slashes", "in_path", "example", "named", "issued",
    "assigned", "quoted", "vowels", "longest_letters",
)

_KIND = np.full(256, 3, np.int64)  # letters in 4 to 29, digits 1, signs 2, else 3
for _b in range(256):
    if chr(_b).isalpha() and _b < 128:
        _KIND[_b] = 4 + ord(chr(_b).lower()) - 97
    elif 48 <= _b <= 57:
        _KIND[_b] = 1
    elif _b in b"+/_-=":
        _KIND[_b] = 2
KINDS = 32


@dataclass(frozen=True)
class Corpus:
    """What the corpus says about ordinary text."""

    surprise: np.ndarray  # KINDS x KINDS, bits
    words: frozenset[bytes]


@dataclass(frozen=True)
class Forest:
    """Trees as arrays; a node without children is its own left child."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Mean over the trees of the share of secrets in each row's leaf."""
        at = np.repeat(self.roots[None], len(x), 0)
        while True:
            go_left = np.take_along_axis(x, self.feature[at], 1) <= self.threshold[at]
            then = np.where(go_left, self.left[at], self.right[at])
            if (then == at).all():
                return self.value[at].mean(1)
            at = then


@dataclass(frozen=True)
class SecretModel:
    corpus: Corpus
    forest: Forest


def corpus_statistics(df: DataFrame, text: str = "text", held_words: int = COUNTED_WORDS) -> Corpus:
    """Transitions and dictionary of all documents.

    A task that holds over `held_words` distinct words sends their counts and
    starts anew, so its memory is bounded and no occurrence is lost.
    """

    def sums(rows: list[tuple[str, bytes, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.binary(), pa.int64()))],
            ["kind", "key", "n"],
        )

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moves = np.zeros(KINDS * KINDS, np.int64)
        counted: Counter[bytes] = Counter()
        total = held = 0
        for batch in batches:
            for start, stop in slices(batch.column(0), 1 << 20):
                joined = b" ".join(text_bytes(batch.column(0).slice(start, stop - start)))
                kinds = _KIND[np.frombuffer(joined, np.uint8)]
                moves += np.bincount(kinds[:-1] * KINDS + kinds[1:], minlength=KINDS * KINDS)
                words = joined.lower().split()
                total += len(words)
                held += len(joined)
                counted.update(words)
                if len(counted) > held_words or held > COUNTED_BYTES:
                    yield sums([("word", w, n) for w, n in counted.items()])
                    counted, held = Counter(), 0
        rows = [("move", str(i).encode(), int(n)) for i, n in enumerate(moves) if n]
        yield sums(rows + [("word", w, n) for w, n in counted.items()] + [("all", b"", total)])

    counts = write_table(
        df.select(text).mapInArrow(summarise, "kind string, key binary, n long")
        .groupBy("kind", "key").agg(F.sum("n").alias("n")),
        "text-statistics",
    )
    total = counts.where("kind = 'all'").agg(F.sum("n")).first()[0] or 0
    least = max(2, total // DICTIONARY)
    # Of 2 * DICTIONARY at most, since each has that share of all occurrences.
    words = counts.where((F.col("kind") == "word") & (F.col("n") >= least)).collect()
    table = np.ones((KINDS, KINDS))
    for r in counts.where("kind = 'move'").collect():  # of KINDS x KINDS at most
        table[divmod(int(bytes(r.key)), KINDS)] += r.n
    shares = table / table.sum(1, keepdims=True)
    return Corpus(-np.log2(shares), frozenset(bytes(r.key) for r in words if len(r.key) > 2))


def coverage(token: bytes, words: frozenset[bytes]) -> float:
    """Share of a token's bytes that dictionary words cover, longest first."""
    lower, at, covered = token.lower(), 0, 0
    while at < len(lower):
        for size in range(min(14, len(lower) - at), 2, -1):
            if lower[at : at + size] in words:
                covered += size
                at += size
                break
        else:
            at += 1
    return covered / max(1, len(token))


def describe(text: bytes, start: int, end: int, path: bytes, corpus: Corpus) -> list[float]:
    """FIELDS of one candidate."""
    token = text[start:end]
    before, after = text[max(0, start - NEAR) : start], text[end : end + NEAR]
    letters = np.frombuffer(token, np.uint8)
    n = len(letters)
    digits = int(((letters >= 48) & (letters <= 57)).sum())
    upper = int(((letters >= 65) & (letters <= 90)).sum())
    lower = int(((letters >= 97) & (letters <= 122)).sum())
    kind = (letters >= 48).astype(int) + (letters >= 65) + (letters >= 97)
    moves = _KIND[letters]
    shares = np.bincount(letters)
    shares = shares[shares > 0] / n
    return [
        float(min(n, 400)),
        float(np.log(n)),
        digits / n,
        upper / n,
        lower / n,
        (n - digits - upper - lower) / n,
        float((kind[1:] != kind[:-1]).mean()),
        float(corpus.surprise[moves[:-1], moves[1:]].mean()),
        float(-(shares * np.log2(shares)).sum()),
        coverage(token, corpus.words),
        float(re.fullmatch(rb"[0-9a-f]+|[0-9A-F]+", token) is not None),
        token.count(b"/") / n,
        float(before[-1:] in b"/\\" and before != b""),
        float(bool(EXAMPLES.search(before) or EXAMPLES.search(after) or EXAMPLES.search(path))),
        float(NAMES.search(before) is not None),
        float(ISSUED.match(token) is not None),
        float(before.rstrip(b"\"' \t")[-1:] in (b"=", b":")),
        float(before[-1:] in (b'"', b"'", b"`")),
        sum(token.lower().count(v) for v in (b"a", b"e", b"i", b"o", b"u")) / n,
        float(max(map(len, re.findall(rb"[A-Za-z]+", token)), default=0)),
    ]


def candidates(df: DataFrame, corpus: Corpus, text: str = "text", path: str | None = None) -> DataFrame:
    """(token, features): one row for each candidate of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, rows = [], []
            paths = text_bytes(batch.column(1))
            for t, p in zip(text_bytes(batch.column(0)), paths):
                for m in CANDIDATE.finditer(t):
                    tokens.append(m.group())
                    rows.append(describe(t, m.start(), m.end(), p, corpus))
            yield pa.RecordBatch.from_arrays(
                [pa.array(tokens, pa.binary()), pa.array(rows, pa.list_(pa.float64()))],
                ["token", "features"],
            )

    where = F.col(path).cast("string") if path else F.lit("")
    return df.select(F.col(text).alias("text"), where.alias("path")).mapInArrow(
        run, "token binary, features array<double>"
    )


def weak_findings(found: DataFrame) -> DataFrame:
    """Labelled findings by what surely is and surely is no secret.

    A mixed token that is assigned to a telling name or has an issuer's prefix
    is one, unless an example is meant; plain words, plain numbers and paths are
    none. Candidates between these get no label.
    """
    f = {name: F.col("features")[i] for i, name in enumerate(FIELDS)}
    mixed = (f["digits"] > 0) & (f["digits"] < 1) & (f["changes"] > 0.05)
    secret = mixed & ((f["named"] > 0) | (f["issued"] > 0)) & (f["example"] == 0)
    plain = (f["digits"] == 0) | (f["digits"] == 1) | (f["in_path"] > 0) | (f["example"] > 0)
    label = F.when(secret, 1.0).when(plain & (f["named"] == 0) & (f["issued"] == 0), 0.0)
    return found.select("token", "features", label.alias("label")).where("label is not null")


def fit_forest(spark, findings: DataFrame, limit: int = LABELLED_FINDINGS) -> Forest:
    """A forest fitted on labelled findings (token, features, label)."""
    distinct = findings.groupBy("token", "label").agg(F.first("features").alias("features"))
    distinct = write_table(distinct, "findings")
    sizes = {r.label: r["count"] for r in distinct.groupBy("label").count().collect()}
    if len(sizes) < 2:  # nothing to tell apart
        share = float(next(iter(sizes), 0.0))
        one = np.zeros(1, np.int64)
        return Forest(one, one, np.zeros(1), one, one, np.array([share]))
    place = F.pmod(F.xxhash64("token", F.lit(SEED)), F.lit(1 << 20))
    shares = {k: min(1.0, limit / 2 / n) for k, n in sizes.items()}
    keep = F.when(F.col("label") > 0.5, shares.get(1.0, 1.0)).otherwise(shares.get(0.0, 1.0))
    rows = distinct.where(place < keep * (1 << 20)).select(array_to_vector("features").alias("features"), "label")
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt").fit(
        rows.coalesce(4)
    )
    path = scratch_path(spark, "forest")
    model.save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()
    at = {(n.treeID, n.id): i for i, n in enumerate(nodes)}
    own = range(len(nodes))
    inner = [n.leftChild >= 0 for n in nodes]
    value = []
    for n in nodes:
        s = n.impurityStats
        value.append(s[1] / max(sum(s), 1e-9) if len(s) > 1 else 0.0)
    return Forest(
        np.array([at[t, 0] for t in sorted({n.treeID for n in nodes})], np.int64),
        np.array([max(n.split.featureIndex, 0) for n in nodes], np.int64),
        np.array(
            [n.split.leftCategoriesOrThreshold[0] if k else 0.0 for n, k in zip(nodes, inner)]
        ),
        np.array([at[n.treeID, n.leftChild] if k else i for i, n, k in zip(own, nodes, inner)]),
        np.array([at[n.treeID, n.rightChild] if k else i for i, n, k in zip(own, nodes, inner)]),
        np.array(value),
    )


def fit(
    df: DataFrame, text: str = "text", path: str | None = None, findings: DataFrame | None = None
) -> SecretModel:
    """Corpus statistics of df, and a forest from labelled findings.

    Without `findings` (token, features, label) they are the ones that
    `weak_findings` is sure about.
    """
    corpus = corpus_statistics(df, text)
    labelled = findings if findings is not None else weak_findings(candidates(df, corpus, text, path))
    return SecretModel(corpus, fit_forest(df.sparkSession, labelled))


FINDING = T.StructType(
    [
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("probability", T.DoubleType()),
        T.StructField("secret", T.BooleanType()),
    ]
)


def scan(df: DataFrame, model: SecretModel, text: str = "text", path: str | None = None) -> DataFrame:
    """df with `findings`, each candidate's place and verdict, and `redacted`.

    Places count code points, the end is exclusive. In `redacted` secrets are
    replaced by a placeholder; NULL texts stay NULL and have no findings.
    Columns of these names are replaced.
    """

    def make():
        def compute(texts: pa.Array, paths: pa.Array | None = None) -> list:
            found, clean = [], []
            where = text_bytes(paths) if paths is not None else [b""] * len(texts)
            for t, p, known in zip(text_bytes(texts), where, texts.is_valid().to_pylist()):
                spans = [m.span() for m in CANDIDATE.finditer(t)]
                rows, pieces, last, units, at = [], [], 0, 0, 0
                if spans:
                    x = np.array([describe(t, s, e, p, model.corpus) for s, e in spans])
                    for (s, e), q in zip(spans, model.forest.predict(x).tolist()):
                        units += len(t[at:s].decode("utf-8", "replace"))
                        rows.append(
                            {"start": units, "end": units + e - s, "probability": q, "secret": q >= THRESHOLD}
                        )
                        units, at = units + e - s, e
                        if q >= THRESHOLD:
                            pieces += [t[last:s], PLACEHOLDER.encode()]
                            last = e
                found.append(rows if known else None)
                clean.append((b"".join([*pieces, t[last:]])).decode("utf-8", "replace") if known else None)
            kind = pa.list_(
                pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64()), ("secret", pa.bool_())])
            )
            return [pa.array(found, kind), pa.array(clean, pa.string())]

        return compute

    fields = [T.StructField("findings", T.ArrayType(FINDING)), T.StructField("redacted", T.StringType())]
    return append_columns(df, text, fields, make, path)
