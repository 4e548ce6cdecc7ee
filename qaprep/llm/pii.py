"""Information-theoretic sanitisation, with DataFrame functions only.

Emails, IP addresses, cards and phone numbers are the protected entities, each
by itself and as a member of its group: the domain, the network, the issuer, the
area code. What else gives an entity away is read from the corpus: a term that
stands near it in several different contexts, and hardly anywhere else, has a
pointwise mutual information with it that comes close to the entity's own
information. Terms beyond one threshold are generalised to a category, beyond a
higher one removed, in the texts that hold the entity or one of its group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaprep.llm.common import write_table

# Fixed values. Possessive loops take what the plain ones take, since nothing
# that they give back could help, and keep long runs from being tried again at
# each place; \G admits a start right after the last match.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"

#: Words on each side of an entity that make up its context.
CONTEXT = 6
#: Different contexts of a term and an entity at least; copies are one context.
CONTEXTS = 3
#: Shares of an entity's information from which a term is generalised, removed.
GENERALISE, REMOVE = 0.6, 0.8
#: Terms up to which the list goes to every task; a longer one is joined.
LISTED_TERMS = 500_000
WORD = r"[\p{L}\p{N}]"
SPAN = "array<struct<start:int,end:int,value:string>>"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    figures = F.split(F.reverse(digits), "")

    def weighed(d: Column, i: Column) -> Column:
        n = d.cast("int")
        twice = n * 2 - F.when(n > 4, 9).otherwise(0)
        return F.when(i % 2 == 1, twice).otherwise(n)

    return F.aggregate(F.transform(figures, weighed), F.lit(0), lambda s, x: s + x) % 10 == 0


def places(text: Column, pattern: Column) -> Column:
    """(start, end, value) of each match, in code points.

    Splitting at the pattern gives what lies between the matches, so places
    are sums of lengths.
    """
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(
        matches, F.slice(gaps, 1, F.size(matches)),
        lambda m, g: F.struct(m.alias("m"), F.length(g).alias("g")),
    )
    walked = F.aggregate(
        pairs,
        F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("found")),
        lambda acc, x: F.struct(
            (acc["at"] + x["g"] + F.length(x["m"])).alias("at"),
            F.array_append(
                acc["found"],
                F.struct(
                    (acc["at"] + x["g"]).alias("start"),
                    (acc["at"] + x["g"] + F.length(x["m"])).alias("end"),
                    x["m"].alias("value"),
                ),
            ).cast(SPAN).alias("found"),
        ),
        lambda acc: acc["found"],
    )
    return walked


def entity_spans(text: Column) -> dict[str, Column]:
    """For each kind its spans: leftmost matches that do not overlap and hold."""
    figures = lambda m: F.regexp_replace(m, "[^0-9]", "")
    many = lambda m, lo, hi: F.length(figures(m)).between(lo, hi)
    rules = {
        "email": (EMAIL, F.contains(text, F.lit("@")), None),
        "ip": (IP, text.rlike(r"[0-9]\.[0-9]"), lambda s: s["value"].rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")),
        "card": (
            CARD, text.rlike(r"[0-9][\x20-]?[0-9]"),
            lambda s: F.when(many(s["value"], 16, 19), luhn(figures(s["value"]))).otherwise(False),
        ),
        "phone": (PHONE, F.contains(text, F.lit("+")), lambda s: many(s["value"], 8, 15)),
    }
    spans = {}
    for kind, (pattern, worth, holds) in rules.items():
        found = F.when(worth, places(text, F.lit(pattern)))
        found = F.filter(found, holds) if holds else found
        spans[kind] = F.coalesce(found, F.array().cast(SPAN))
    return spans


def joined(spans: dict[str, Column]) -> Column:
    """kind:start:end of all spans, comma-joined, by kind and start."""
    return F.array_join(F.concat(*[_named(kind, s) for kind, s in spans.items()]), ",")


def _named(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x["start"], x["end"]))


def _contexts(found: DataFrame) -> DataFrame:
    """(entity, hash, context, term): words around each entity of a text."""
    one = found.select("hash", "text", F.explode(_all_entities()).alias("e"))
    before = F.expr("substring(text, greatest(e.start - 200, 0) + 1, least(e.start, 200))")
    after = F.expr("substring(text, e.end + 1, 200)")
    parts = lambda t: F.filter(F.split(F.lower(t), f"(?U)[^{WORD[1:-1]}]+"), lambda w: w != "")
    words = one.select(
        "hash", "e.entity",
        F.slice(F.reverse(parts(before)), 1, CONTEXT).alias("b"),
        F.slice(parts(after), 1, CONTEXT).alias("a"),
    )
    return words.select(
        "entity", "hash", F.xxhash64("b", "a").alias("context"),
        F.explode(F.array_distinct(F.concat("b", "a"))).alias("term"),
    ).where((F.length("term") >= 3) & F.col("term").rlike(r"^\p{L}+$"))


def _group(kind: str, value: Column) -> Column:
    """What an entity shares with its neighbours: domain, network, issuer, area."""
    figures = F.regexp_replace(value, "[^0-9]", "")
    return {
        "email": F.lower(F.regexp_extract(value, "@(.*)", 1)),
        "ip": F.regexp_extract(value, r"^([0-9]+\.[0-9]+)\.", 1),
        "card": F.substring(figures, 1, 6),
        "phone": F.substring(figures, 1, 4),
    }[kind]


def _tagged(kind: str) -> Column:
    """The entity and its group for each span of a kind."""

    def named(tag: str, value) -> Column:
        return F.transform(
            kind,
            lambda s: F.struct(
                F.concat_ws(":", F.lit(tag), value(s["value"])).alias("entity"),
                s["start"].alias("start"), s["end"].alias("end"),
            ),
        )

    return F.concat(named(kind, F.lower), named(f"{kind} group", lambda v: _group(kind, v)))


def _words(rows: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, term): the distinct words of each row, in small letters."""
    parts = F.split(F.lower(F.col(text)), f"(?U)[^{WORD[1:-1]}]+")
    return rows.select(*keys, F.explode(F.array_distinct(parts)).alias("term"))


def disclosing_terms(documents: DataFrame, found: DataFrame, text: str) -> DataFrame:
    """(entity, term, share): terms and the share of the entity's information.

    The share is PMI(entity; term) / information(entity), from the numbers of
    documents that hold the entity, the term, and both near each other. How
    many documents with entities hold a term is a lower bound of the second
    number. It rules out common terms before all documents are counted. An
    entity that all documents hold has no information that a term could give
    away.
    """
    near = _contexts(found)
    holds = found.select(F.explode(F.array_distinct(F.transform(_all_entities(), lambda e: e["entity"]))).alias("entity"))
    entities = holds.groupBy("entity").agg(F.count("*").alias("n_entity"))
    total = F.lit(documents.count()).cast("double")

    def share(n_term: str) -> Column:
        mutual = F.log2(F.least("both", n_term) * total / (F.col("n_entity") * F.col(n_term)))
        return F.try_divide(mutual, F.log2(total / F.col("n_entity")))

    # Copies of a text are one context, but each of them is a document.
    near = near.distinct()
    contexts = (
        near.select("entity", "term", "context").distinct()
        .groupBy("entity", "term").agg(F.count("*").alias("contexts"))
        .where(F.col("contexts") >= CONTEXTS)
    )
    copies = found.groupBy("hash").agg(F.count("*").alias("copies"))
    together = (
        near.select("entity", "term", "hash").distinct().join(copies, "hash")
        .groupBy("entity", "term").agg(F.sum("copies").alias("both"))
    )
    pairs = contexts.join(together, ["entity", "term"])
    least = _words(found, text).groupBy("term").agg(F.count("*").alias("n_least"))
    pairs = write_table(
        pairs.join(least, "term").join(entities, "entity").where(share("n_least") >= GENERALISE), "pairs"
    )
    terms = write_table(pairs.select("term").distinct(), "terms")
    everywhere = _words(documents, text)
    if terms.count() <= LISTED_TERMS:
        everywhere = everywhere.join(F.broadcast(terms), "term", "left_semi")
    frequency = everywhere.groupBy("term").agg(F.count("*").alias("n_term"))
    return (
        pairs.join(frequency, "term")
        .select("entity", "term", share("n_term").alias("share"))
        .where(F.col("share") >= GENERALISE)
    )


def _all_entities() -> Column:
    return F.concat(*[_tagged(k) for k in KINDS])


def sanitise(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of df: its id, a span array for each kind, and
    `generalise`, `remove` (spans of terms) and `sanitised`.

    `sanitised` is the text with entities and terms replaced; NULL if nothing
    was found, so that the text stays as it is. NULL texts count as empty.
    Repeated rows get equal results; NULL ids are kept. Other columns are not
    read. Spans start from 0 in code points, the end is exclusive.
    """
    documents = df.select(F.col(id_column).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    spans = entity_spans(F.col("text"))
    with_spans = documents.select("id", "text", *[s.alias(k) for k, s in spans.items()])
    any_span = sum((F.size(k) for k in KINDS), F.lit(0)) > 0
    rows = write_table(
        with_spans.select(
            "id", *KINDS,
            F.when(any_span, F.col("text")).alias("text"),
            F.when(any_span, F.md5("text")).alias("hash"),
        ),
        "entities",
    )
    found = rows.where("hash is not null")
    disclosed = write_table(disclosing_terms(documents, found, "text"), "disclosed")
    held = found.select("hash", F.explode(F.array_distinct(F.transform(_all_entities(), lambda e: e["entity"]))).alias("entity")).distinct()
    # A text's own words are looked up, so that a common entity with many terms
    # does not send all of them to all of its texts.
    by_text = (
        _words(found, "text", "hash").join(disclosed, "term")
        .join(held, ["hash", "entity"], "left_semi")
        .groupBy("hash", "term").agg(F.max("share").alias("share"))
        .groupBy("hash").agg(
            F.sort_array(F.collect_list(F.when(F.col("share") >= REMOVE, F.col("term")))).alias("gone"),
            F.sort_array(F.collect_list(F.when(F.col("share") < REMOVE, F.col("term")))).alias("vague"),
        )
    )
    # Rows without entities have no hash and do not meet the join's other side.
    ready = found.join(by_text, "hash", "left").select(
        "id", *KINDS, "text", _terms("vague").alias("generalise"), _terms("gone").alias("remove")
    )
    none = F.array().cast(SPAN)
    plain = rows.where("hash is null").select(
        "id", *KINDS, none.alias("generalise"), none.alias("remove"), F.lit(None).cast("string").alias("sanitised")
    )
    cleaned = ready.select("id", *KINDS, "generalise", "remove", _replaced().alias("sanitised"))
    return cleaned.unionByName(plain).withColumnRenamed("id", id_column)


def _terms(column: str) -> Column:
    pattern = F.concat(
        F.lit(rf"(?iu)(?<!{WORD})(?:"), F.array_join(column, "|"), F.lit(rf")(?!{WORD})")
    )
    found = F.when(F.size(column) > 0, places(F.col("text"), pattern))
    return F.coalesce(found, F.array().cast(SPAN))


def _replaced() -> Column:
    """The text with spans replaced; of overlapping spans the first one.

    Entities become their kind, removed terms one mark, and generalised terms
    what their letters show: an acronym, a name or a word.
    """
    labels = {k: (lambda v, k=k: F.lit(f"[{k.upper()}]")) for k in KINDS} | {
        "remove": lambda v: F.lit("[REMOVED]"),
        "generalise": lambda v: F.when(v.rlike(r"^\p{Lu}{2,}$"), "[ACRONYM]")
        .when(v.rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]"),
    }

    def labelled(kind: str, label) -> Column:
        return F.transform(
            kind,
            lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), label(s["value"]).alias("label")),
        )

    spans = F.array_sort(F.concat(*[labelled(k, v) for k, v in labels.items()]))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
        more = F.struct(s["end"].alias("at"), F.concat(acc["parts"], F.array(gap, s["label"])).alias("parts"))
        return F.when(s["start"] >= acc["at"], more).otherwise(acc)

    return F.aggregate(
        spans, start, step,
        lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(F.col("text"), acc["at"] + 1, F.length("text"))),
    )
