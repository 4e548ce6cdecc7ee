"""Plain Python versions of the rules, to test the Spark functions against."""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

import duckdb

from qaprep.plans.oracles import LABEL, sentences, stems
from qaprep.plans.oracles import clean as cleaned


def clean(text):
    return re.sub(r"\s+", " ", text or "").strip()


@lru_cache(maxsize=None)
def stemmed(words):
    return duckdb.execute(f"SELECT {stems('?::VARCHAR[]')}", [list(words)]).fetchone()[0]


def tokens(text, stem=False):
    found = re.findall("[a-z0-9]+", (text or "").lower())
    return stemmed(tuple(found)) if stem else found


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def grams(a, n):
    return Counter(tuple(a[i : i + n]) for i in range(len(a) - n + 1))


def f1(matches, predicted, reference):
    if not matches:
        return 0.0
    p, r = matches / predicted, matches / reference
    return 2 * p * r / (p + r)


def rouge_n(a, b, n):
    left, right = grams(a, n), grams(b, n)
    return f1((left & right).total(), left.total(), right.total())


def rouge_l(a, b):
    return f1(lcs(a, b), len(a), len(b))


def bleu(pairs, floor):
    """BLEU over (predicted, reference) token lists."""
    matches, totals = [0] * 4, [0] * 4
    for a, b in pairs:
        for n in range(1, 5):
            matches[n - 1] += (grams(a, n) & grams(b, n)).total()
            totals[n - 1] += max(len(a) - n + 1, floor)
    if min(matches) == 0:
        return 0.0
    c, r = sum(len(a) for a, _ in pairs), sum(len(b) for _, b in pairs)
    penalty = 0.0 if c > r else 1 - r / c
    return math.exp(penalty + sum(math.log(m / t) for m, t in zip(matches, totals)) / 4)


def overlap(label_text, text):
    wanted = set(re.findall(r"\w+", label_text.lower()))
    return len(wanted & set(re.findall(r"\w+", text.lower()))) / len(wanted) if wanted else 0.0


def oracle(parts, reference, k=3, minimum=5, stem=True):
    """The k best sentences in text order, and the best score; ties to the first."""
    wanted = tokens(reference, stem)
    ranks = sorted(
        (-rouge_l(tokens(part, stem), wanted), place)
        for place, part in enumerate(parts)
        if part.count(" ") >= minimum - 1
    )
    if not ranks:
        return "", 0.0
    chosen = {place for _, place in ranks[:k]}
    return " ".join(part for place, part in enumerate(parts) if place in chosen), -ranks[0][0]


def curate(row, scope="trimmed", stem=True):
    """(kept by the cheap rules, oracle text, oracle score) of one raw row."""
    target, parts = duckdb.execute(
        f"SELECT {LABEL}, {sentences(cleaned('abstract'))} FROM (SELECT ? AS label, ? AS abstract)",
        [row["label"], row["abstract"]],
    ).fetchone()
    parts = parts[:8] if scope == "trimmed" else parts
    cheap = 5 <= len(target.split()) <= 40 and overlap(target, " ".join(parts)) >= 0.45
    return cheap, *oracle(parts, f"{clean(row['query'])} {target}", stem=stem)
