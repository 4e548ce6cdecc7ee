"""Language identification by error-correcting output codes.

Each language has a codeword of bits. For every bit a binary classifier over
hashed byte n-grams tells the languages whose bit is set from the others:
weights are smoothed log odds of n-gram shares. The codeword with the least
loss, summed over the bits with weights that follow each bit's accuracy, is
the answer; a small lead over the second best is flagged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qaprep.llm.common import append_columns, text_bytes, write_table

#: Documents of each language that are learned from at most, chosen by the hash
#: of their id; it bounds the work of fitting.
DOCUMENTS_PER_LANGUAGE = 2_500
MOST_LANGUAGES = 400
SLOTS = 1 << 14
FIT_TASKS = 16
AMBIGUOUS = 0.2
UNDETERMINED = "und"
SEED = 23

_PLAIN = bytes(
    b if b >= 128 or chr(b).islower() else ord(chr(b).lower()) if chr(b).isupper() else 32
    for b in range(256)
)


def gram_counts(text: bytes) -> np.ndarray:
    """Counts of hashed 1- to 3-grams of letters; other ASCII bytes are gaps."""
    plain = b" ".join((b" " + text.translate(_PLAIN) + b" ").split())
    b = np.frombuffer(b" " + plain + b" ", np.uint8).astype(np.uint32)
    pair = b[:-1] | (b[1:] << 8)
    triple = pair[:-1] | (b[2:] << 16)
    both = np.concatenate([pair + np.uint32(1 << 24), triple])
    slots = (both * np.uint32(2654435761)) >> np.uint32(18)
    return np.bincount(slots.astype(np.int64), minlength=SLOTS)


def codewords(count: int) -> np.ndarray:
    """A codeword of +1 and -1 for each of `count` languages.

    Up to six: every way to part the languages in two. More: of many seeded
    draws the one with the largest least distance.
    """
    if count <= 1:
        return np.ones((count, 1))
    if count <= 6:
        parts = range(1, 1 << (count - 1))
        return np.array([[1 if p >> k & 1 else -1 for p in parts] for k in range(count)])
    random = np.random.default_rng(SEED)
    bits = int(np.ceil(12 * np.log2(count)))
    best, best_distance = None, -1
    for _ in range(60):
        code = random.choice([-1, 1], (count, bits))
        near = (bits - code @ code.T) // 2 + bits * np.eye(count, dtype=int)
        useful = (np.abs(code.sum(0)) < count).all()
        if useful and near.min() > best_distance:
            best, best_distance = code, near.min()
    return best


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # slots x bits
    trust: np.ndarray  # weight of each bit's loss

    def margins(self, counts: np.ndarray) -> np.ndarray:
        total = counts.sum(1, keepdims=True)
        return np.clip(counts @ self.weights / np.maximum(np.sqrt(total), 1), -8, 8)

    def losses(self, counts: np.ndarray) -> np.ndarray:
        """Loss of each language's codeword for each row."""
        margins = self.margins(counts)[:, None, :] * self.code[None]
        return (np.logaddexp(0, -margins) * self.trust).sum(2)

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number, its share of belief, and its lead over the next."""
        losses = self.losses(counts)
        belief = np.exp(losses.min(1, keepdims=True) - losses)
        belief /= belief.sum(1, keepdims=True)
        best = belief.argmax(1)
        ordered = np.sort(belief, axis=1)
        lead = ordered[:, -1] - (ordered[:, -2] if belief.shape[1] > 1 else 0)
        return best, ordered[:, -1], lead


def fit(
    documents: DataFrame,
    learn: Column,
    text: str = "text",
    lang: str = "lang",
    id_column: str = "doc_id",
    limit: int = DOCUMENTS_PER_LANGUAGE,
) -> LanguageModel:
    """Learn from text and language of the rows for which `learn` holds.

    At most about `limit` documents of each language are used. Rows without
    text or language are not.
    """
    rows = documents.where(learn & F.col(text).isNotNull() & F.col(lang).isNotNull())
    found = rows.groupBy(F.col(lang).alias("lang")).count().limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages to learn")
    names = tuple(sorted(r.lang for r in found))
    if not names:
        return LanguageModel((), np.ones((0, 1)), np.zeros((SLOTS, 1)), np.ones(1))
    share = F.create_map(*[F.lit(x) for r in found for x in (r.lang, min(1.0, limit / r["count"]))])
    place = F.pmod(F.xxhash64(id_column, F.lit(SEED)), F.lit(1 << 20))
    sample = write_table(
        rows.where(place < share[F.col(lang)] * (1 << 20))
        .select(F.col(lang).alias("lang"), F.col(text).alias("text"))
        .repartition(FIT_TASKS),
        "languages",
    )
    number = {name: i for i, name in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                grams = gram_counts(t)
                sums[number[name]] = sums.get(number[name], 0) + grams
        for k, grams in sums.items():
            at = np.flatnonzero(grams)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), k, np.int64)), pa.array(at), pa.array(grams[at])],
                ["k", "slot", "n"],
            )

    counted = (
        sample.mapInArrow(count, "k long, slot long, n long")
        .groupBy("k", "slot").agg(F.sum("n").alias("n")).toPandas()
    )  # of languages x slots rows at most
    per_language = np.zeros((len(names), SLOTS))
    per_language[counted.k.to_numpy(int), counted.slot.to_numpy(int)] = counted.n.to_numpy(float)
    code = codewords(len(names))
    weights = np.zeros((SLOTS, code.shape[1]))
    shares = per_language / np.maximum(per_language.sum(1, keepdims=True), 1)
    for bit in range(code.shape[1] if len(names) > 1 else 0):
        # Languages weigh alike on each side, whatever their number of documents.
        one, other = (shares[code[:, bit] == s].mean(0) for s in (1, -1))
        weights[:, bit] = np.log(one + 1e-5) - np.log(other + 1e-5)
    plain = LanguageModel(names, code, weights, np.ones(code.shape[1]))

    def right(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(code.shape[1] + 1)
        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                margin = plain.margins(gram_counts(t)[None])[0]
                total[:-1] += margin * code[number[name]] > 0
                total[-1] += 1
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["v"])

    sums = np.sum([r.v for r in sample.mapInArrow(right, "v array<double>").collect()], axis=0)
    accuracy = np.clip((sums[:-1] + 1) / (sums[-1] + 2), 0.5, 0.999)
    trust = np.log(accuracy / (1 - accuracy)) + 0.01
    return LanguageModel(names, code, weights, trust / trust.mean())


def identify(df: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """df with `lang_pred`, `score` (0 to 1) and `ambiguous`.

    NULL texts and texts without a letter are `und` with score 0, and so is
    everything if nothing was learned. Repeated rows get equal results; columns
    of these names are replaced.
    """
    weights = model.weights.astype(np.float32)

    def make():
        small = LanguageModel(model.languages, model.code, weights, model.trust)

        def compute(texts: pa.Array) -> list:
            raw = text_bytes(texts)
            names: list[str] = [UNDETERMINED] * len(raw)
            scores, leads = np.zeros(len(raw)), np.zeros(len(raw))
            known = [
                i for i, t in enumerate(raw)
                if small.languages and any(map(str.isalpha, t.decode("utf-8", "replace")))
            ]
            for start in range(0, len(known), 64):
                at = known[start : start + 64]
                counts = np.array([gram_counts(raw[i]) for i in at], np.float32)
                best, belief, lead = small.predict(counts)
                scores[at], leads[at] = belief, lead
                for i, k in zip(at, best.tolist()):
                    names[i] = small.languages[k]
            return [pa.array(names, pa.string()), pa.array(scores), pa.array(leads < AMBIGUOUS)]

        return compute

    fields = [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("ambiguous", T.BooleanType()),
    ]
    return append_columns(df, text, fields, make)
