"""DuckDB SQL that gives the same rows as the registered queries.

Written from the rules, not from the Spark code: windows instead of chunks,
list expressions instead of higher-order functions, a recursive query for the
longest common subsequence, substitutions without look-around for stems.
"""

from __future__ import annotations

from functools import reduce

from qaprep.functions.stem import IRREGULAR
from qaprep.functions.stem_rules import MARKS, STEPS, Rule

# RE2 knows only ASCII whitespace by name, so the rest is spelled out.
WS = (
    r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
    r"\x{202f}\x{205f}\x{3000}"
)
WORD = r"\p{L}\p{N}_"



def clean(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '[{WS}]+', ' ', 'g'))"


def clean_punct(x: str) -> str:
    bare = f"regexp_replace(coalesce({x}, ''), '[^{WORD}{WS}]', '', 'g')"
    return clean(bare)


def clean_lower(x: str) -> str:
    return clean_punct(f"lower(coalesce({x}, ''))")


def sentences(x: str) -> str:
    marked = f"regexp_replace({x}, '([.!?]) ', '\\1' || chr(1), 'g')"
    return (
        f"(CASE WHEN {x} = '' THEN CAST([] AS VARCHAR[]) "
        f"ELSE string_split({marked}, chr(1)) END)"
    )


def words(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[{WORD}]+')"


def rouge(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9]+')"


def _stem_case(rules: list[Rule]) -> str:
    """One step of stemming a word `w`."""
    cases = ["WHEN suffix(w, '!') THEN w"]
    for rule in rules:
        fits = f"regexp_matches(w, '{rule.ending}')" if rule.pattern else f"suffix(w, '{rule.ending}')"
        changed = f"regexp_replace(w, '{rule.change}', '{rule.into}')" if rule.change else "w"
        cases.append(f"WHEN {fits} THEN {changed}")
    return f"CASE {' '.join(cases)} ELSE w END"


def stems(tokens: str) -> str:
    """The stems of a list of lower-case tokens."""
    marked = reduce(lambda w, mark: f"regexp_replace({w}, '{mark[0]}', '{mark[1]}', 'g')", MARKS, "w")
    known = " ".join(f"WHEN w = '{word}' THEN '{stem}!'" for word, stem in IRREGULAR.items())
    begun = f"CASE WHEN len(w) <= 3 THEN w || '!' {known} ELSE {marked} END"
    bodies = [begun, *[_stem_case(rules) for rules in STEPS], "translate(w, 'Y!', 'y')"]
    return reduce(lambda words, body: f"list_transform({words}, lambda w: {body})", bodies, tokens)


def rouge_stems(x: str) -> str:
    return stems(rouge(x))


def bleu(x: str, mode: str) -> str:
    if mode == "13a":
        for old, new in (
            ("'<skipped>'", "''"),
            ("'-' || chr(10)", "''"),
            ("chr(10)", "' '"),
            ("'&quot;'", "'\"'"),
            ("'&amp;'", "'&'"),
            ("'&lt;'", "'<'"),
            ("'&gt;'", "'>'"),
        ):
            x = f"replace({x}, {old}, {new})"
        x = f"(' ' || {x} || ' ')"
        for pattern, parted in (
            (r"([\{-\~\[-\x60 -\&\(-\+\:-\@\/])", r" \1 "),
            (r"([^0-9])([\.,])", r"\1 \2 "),
            (r"([\.,])([^0-9])", r" \1 \2"),
            (r"([0-9])(-)", r"\1 \2 "),
        ):
            x = f"regexp_replace({x}, '{pattern}', '{parted}', 'g')"
    return f"regexp_extract_all({x}, '[^{WS}]+')"


def word_count(x: str) -> str:
    return f"(CASE WHEN {x} = '' THEN 0 ELSE len(string_split({x}, ' ')) END)"


def joined(x: str) -> str:
    return f"coalesce(array_to_string({x}, '|'), '')"


def grams(tokens: str, n: int) -> str:
    if n == 1:
        return tokens
    return (
        f"list_transform(range(1, len({tokens}) - {n} + 2), "
        f"lambda i: array_to_string({tokens}[i:i + {n - 1}], chr(1)))"
    )


def clipped(a: str, b: str) -> str:
    return (
        f"coalesce(list_sum(list_transform(list_intersect({a}, {b}), lambda g: "
        f"least(len(list_filter({a}, lambda x: x = g)), "
        f"len(list_filter({b}, lambda y: y = g))))), 0)"
    )


def f1(m: str, p: str, r: str) -> str:
    ratio_p, ratio_r = f"({m}::DOUBLE / {p})", f"({m}::DOUBLE / {r})"
    return (
        f"(CASE WHEN {m} > 0 THEN 2 * {ratio_p} * {ratio_r} / ({ratio_p} + {ratio_r}) "
        "ELSE 0.0 END)"
    )


# The views of the tables

RAW = rf"""raw_qa AS (
  SELECT conv_id * 1000 + turn AS row_id,
         replace(asked, ', ', ',' || chr(160)) AS query,
         CASE WHEN conv_id % 2 = 0 THEN us[1] END AS title,
         abstract,
         '"' || coalesce(CASE WHEN conv_id % 3 = 0 THEN us[1]
                              ELSE array_to_string(s[1:2], ' ') END, '')
             || CASE WHEN conv_id % 5 = 0 THEN ' .' ELSE '' END || '"' AS label
  FROM (SELECT *, {sentences("uc")} AS us, {sentences("ac")} AS s
        FROM (SELECT u.conv_id, u.turn, u.text AS asked, a.text AS abstract,
                     {clean("u.text")} AS uc, {clean("a.text")} AS ac
              FROM conversations u JOIN conversations a
                ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
              WHERE u.role = 'user' AND a.role = 'assistant')))"""

_STRAIGHT = (
    f"trim(replace(replace(replace(trim({clean('label')}, '\"'), "
    "chr(8220), '\"'), chr(8221), '\"'), chr(8217), ''''))"
)
LABEL = f"regexp_replace({_STRAIGHT}, ' \\.$', '')"

CLEANED = RAW + rf""", cleaned AS (
  SELECT *, {word_count("label")}::INTEGER AS label_tokens,
         {sentences("abstract")} AS all_sents
  FROM (SELECT row_id, {clean("query")} AS query, {clean("title")} AS title,
               {clean("abstract")} AS abstract, {LABEL} AS label FROM raw_qa))"""


def overlapped(scope: str = "trimmed") -> str:
    part = "all_sents[1:8]" if scope == "trimmed" else "all_sents"
    shared = "len(list_intersect(label_set, text_set))"
    return CLEANED + rf""", overlapped AS (
  SELECT *, CASE WHEN len(label_set) = 0 THEN 0.0
                 ELSE {shared}::DOUBLE / len(label_set) END AS overlap
  FROM (SELECT *, {part} AS sents,
               array_to_string(all_sents[1:8], ' ') AS abstract_trimmed,
               list_distinct({words("label")}) AS label_set,
               list_distinct({words(f"array_to_string({part}, ' ')")}) AS text_set
        FROM cleaned))"""


def lcs(pairs: str) -> str:
    """CTEs that give `lcs(pid, lcs)` for `pairs(pid, a, b)` of token lists.

    Row i of the usual table for all pairs at once. A cell is the largest of
    the cells to its left and above it, one more than the diagonal on a match.
    """
    return rf"""lcs_rows(pid, i, cells) AS (
  SELECT pid, 0, list_transform(b, lambda x: 0) FROM {pairs}
  UNION ALL
  SELECT pid, i, list_transform(range(1, len(best) + 1), lambda j: list_max(best[1:j]))
  FROM (SELECT r.pid, r.i + 1 AS i,
               list_transform(range(1, len(p.b) + 1), lambda j: greatest(r.cells[j],
                 CASE WHEN p.b[j] = p.a[r.i + 1]
                      THEN (CASE WHEN j > 1 THEN r.cells[j - 1] ELSE 0 END) + 1
                      ELSE 0 END)) AS best
        FROM lcs_rows r JOIN {pairs} p ON p.pid = r.pid WHERE r.i < len(p.a))
), lcs AS (
  SELECT r.pid, coalesce(r.cells[len(r.cells)], 0) AS lcs
  FROM lcs_rows r JOIN {pairs} p ON p.pid = r.pid AND r.i = len(p.a))"""


def scored(scope: str = "trimmed", stem: bool = False) -> str:
    tokens = rouge_stems if stem else rouge
    return overlapped(scope) + rf""", sents AS (
  SELECT row_id, k AS idx, sents[k] AS sent, query || ' ' || label AS reference
  FROM (SELECT *, unnest(range(1, len(sents) + 1)) AS k FROM overlapped)
), sent_pairs AS (
  SELECT row_id * 1000 + idx AS pid, row_id, idx, sent,
         {tokens("sent")} AS a, {tokens("reference")} AS b
  FROM sents WHERE {word_count("sent")} >= 5
), {lcs("sent_pairs")}, sent_scores AS (
  SELECT p.row_id, p.idx, p.sent, {f1("l.lcs", "len(p.a)", "len(p.b)")} AS score
  FROM sent_pairs p JOIN lcs l ON l.pid = p.pid
), oracles AS (
  SELECT row_id, string_agg(sent, ' ' ORDER BY idx) AS oracle_text,
         max(score) AS oracle_score
  FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, idx) AS place
        FROM sent_scores)
  WHERE place <= 3 GROUP BY row_id
), scored AS (
  SELECT o.*, coalesce(x.oracle_text, '') AS oracle_text,
         coalesce(x.oracle_score, 0.0) AS oracle_score
  FROM overlapped o LEFT JOIN oracles x ON x.row_id = o.row_id)"""


INSTRUCTION = (
    "Instruction: Answer the question using only the abstract. If the abstract does "
    "not contain the answer, respond with ''Not enough information.''."
)


def answer(abstract: str) -> str:
    return (
        f"'{INSTRUCTION} Question: ' || query || "
        "CASE WHEN title <> '' THEN ' Title: ' || title ELSE '' END "
        f"|| ' Abstract: ' || {abstract}"
    )


CHEAP = "label_tokens BETWEEN 5 AND 40 AND overlap >= 0.45"
KEPT = f"{CHEAP} AND oracle_score >= 0.15 AND len(oracle_text) > 0"


def curated(scope: str, where: str, target: str, stem: bool = False) -> str:
    return f"""WITH RECURSIVE {scored(scope, stem)}
SELECT row_id, {answer("abstract_trimmed")} AS input_text, {target} AS target_text,
       query, title, abstract_trimmed, label, oracle_text,
       round(oracle_score, 6) AS "oracle_rougeL", round(overlap, 6) AS overlap, label_tokens
FROM scored WHERE {where}"""


BULLETS = (
    f"coalesce(array_to_string(list_transform({sentences('oracle_text')}[1:3], "
    "lambda s: '- ' || s), chr(10)), '')"
)

PREDICTIONS = scored() + f""", predictions AS (
  SELECT row_id, 'base_seed' || (13 + row_id % 3) AS run, label AS predicted,
         array_to_string(CASE WHEN row_id % 3 = 1 THEN s[1:2] ELSE s[2:3] END, ' ')
           AS reference
  FROM (SELECT *, {sentences("abstract_trimmed")} AS s FROM scored WHERE {KEPT}))"""

def rouge_pairs(stem: bool = False) -> str:
    tokens = rouge_stems if stem else rouge
    return PREDICTIONS + f""", pred_pairs AS (
  SELECT row_id AS pid, row_id, run, predicted, reference,
         {tokens("predicted")} AS a, {tokens("reference")} AS b FROM predictions)"""


ROUGE_PAIRS = rouge_pairs()


def rouge_scores(stem: bool = False) -> str:
    pair_lcs = (
        lcs("pred_pairs").replace("lcs_rows", "pred_rows").replace("lcs AS (", "pred_lcs AS (")
    )
    a2, b2 = grams("a", 2), grams("b", 2)
    return rouge_pairs(stem) + f""", {pair_lcs}, rouge_scores AS (
  SELECT g.row_id, g.run, {f1("m1", "len(a)", "len(b)")} AS rouge1,
         {f1("m2", "(len(a) - 1)", "(len(b) - 1)")} AS rouge2,
         {f1("l.lcs", "len(a)", "len(b)")} AS rougel, l.lcs AS lcs
  FROM (SELECT *, {clipped("a", "b")} AS m1, {clipped("a2", "b2")} AS m2
        FROM (SELECT *, {a2} AS a2, {b2} AS b2 FROM pred_pairs)) g
  JOIN pred_lcs l ON l.pid = g.pid)"""


def bleu_counts(mode: str, base: str = PREDICTIONS) -> str:
    floor = 1 if mode == "ws" else 0
    matches = ", ".join(
        f"{clipped(f'p{n}', f'r{n}')}::INTEGER AS match{n}, "
        f"greatest(len(p1) - {n - 1}, {floor})::INTEGER AS total{n}"
        for n in (1, 2, 3, 4)
    )
    lists = ", ".join(
        f"{grams('p', n)} AS p{n}, {grams('r', n)} AS r{n}" for n in (1, 2, 3, 4)
    )
    return base + f""", bleu_{mode} AS (
  SELECT row_id, run, len(p1)::INTEGER AS pred_len, len(r1)::INTEGER AS ref_len, {matches}
  FROM (SELECT row_id, run, {lists}
        FROM (SELECT *, {bleu("predicted", mode)} AS p, {bleu("reference", mode)} AS r
              FROM predictions)))"""


COUNT_COLUMNS = "pred_len, ref_len, match1, match2, match3, match4, total1, total2, total3, total4"
SUMS = ", ".join(f"sum({c})::DOUBLE AS {c}" for c in COUNT_COLUMNS.split(", "))


def bleu_score() -> str:
    logs = " + ".join(f"ln(match{n}::DOUBLE / total{n})" for n in (1, 2, 3, 4))
    some = " AND ".join(f"match{n} > 0" for n in (1, 2, 3, 4))
    penalty = "CASE WHEN pred_len > ref_len THEN 0.0 ELSE 1 - ref_len::DOUBLE / pred_len END"
    return f"(CASE WHEN {some} THEN exp({penalty} + ({logs}) / 4) ELSE 0.0 END)"


def text_metrics(by_run: bool, stem: bool = False) -> str:
    run, group = ("run, ", " GROUP BY run") if by_run else ("", "")
    join = "USING (run)" if by_run else "ON true"
    return f"""WITH RECURSIVE {bleu_counts("13a", rouge_scores(stem))},
b AS (SELECT {run}{SUMS} FROM bleu_13a{group}),
r AS (SELECT {run}avg(rouge1) AS r1, avg(rouge2) AS r2, avg(rougel) AS rl
      FROM rouge_scores{group})
SELECT {run}round({bleu_score()}, 6) AS bleu, round(r1, 6) AS rouge1,
       round(r2, 6) AS rouge2, round(rl, 6) AS "rougeL"
FROM b JOIN r {join}"""


def evaluate(stem: bool = False) -> str:
    return f"""WITH RECURSIVE {bleu_counts("ws", rouge_scores(stem))},
b AS (SELECT run, avg({bleu_score()}) AS bleu FROM bleu_ws GROUP BY run),
r AS (SELECT run, avg(rouge1) AS r1, avg(rouge2) AS r2, avg(rougel) AS rl
      FROM rouge_scores GROUP BY run),
e AS (SELECT run, avg((predicted = reference)::INTEGER) AS em FROM predictions GROUP BY run)
SELECT run, round(bleu, 6) AS bleu, round(r1, 6) AS rouge1, round(r2, 6) AS rouge2,
       round(rl, 6) AS "rougeL", round(em, 6) AS exact_match
FROM b JOIN r USING (run) JOIN e USING (run)"""

SCORE_ROWS = f"""WITH RECURSIVE {bleu_counts("ws", rouge_scores(stem=True))}
SELECT row_id, run, round({bleu_score()}, 6) AS bleu_score, round(rouge1, 6) AS rouge1,
       round(rouge2, 6) AS rouge2, round(rougel, 6) AS "rougeL",
       (predicted = reference)::INTEGER::DOUBLE AS exact_match
FROM bleu_ws JOIN rouge_scores USING (row_id, run) JOIN predictions USING (row_id, run)"""

EVAL_LOG = """eval_log AS (
  SELECT (user_id % 20)::INTEGER AS run,
         row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts, event_id) AS step,
         value AS metric, epoch_us(ts) / 1000000.0 AS ts_s
  FROM events)"""

TRAIN_LOG = (
    EVAL_LOG
    + """, train_log AS (
  SELECT run, step // 2 AS step, ts_s, metric AS loss FROM eval_log)"""
)

RUN_METRICS = """run_metrics AS (
  SELECT (user_id % 20)::INTEGER AS run, avg(value) AS latency, max(value) / 500 AS rougel
  FROM events GROUP BY 1)"""

LONG_METRICS = (
    RUN_METRICS
    + """, long_metrics AS (
  SELECT 'config' || (run % 4) || '_seed' || run AS run, unnest(['latency', 'rougeL']) AS metric,
         unnest([latency, rougel]) AS value
  FROM run_metrics)"""
)

SUMM = f"""summ AS (
  SELECT doc_id, text AS source, coalesce({sentences("cleaned")}[1], '') AS target,
         ['train', 'validation', 'test'][doc_id % 3 + 1] AS split
  FROM (SELECT *, {clean("text")} AS cleaned FROM documents))"""


def read_metrics(accuracy: str, speed: str, absent: str) -> str:
    return f"""WITH {RUN_METRICS}, m AS (
  SELECT '{accuracy}' AS run, 'best' AS metric, max(rougel) AS value FROM run_metrics
  UNION ALL SELECT '{accuracy}', 'mean', avg(rougel) FROM run_metrics
  UNION ALL SELECT '{speed}', 'best', max(latency) FROM run_metrics
  UNION ALL SELECT '{speed}', 'mean', avg(latency) FROM run_metrics
  UNION ALL SELECT '{absent}', NULL, NULL)
SELECT run, metric, round(value, 6) AS value FROM m"""


def running_best(greater: bool) -> str:
    how, sign = ("max", ">") if greater else ("min", "<")
    return f"""WITH {EVAL_LOG}, b AS (
  SELECT run, step, metric, {how}(metric) OVER (PARTITION BY run ORDER BY step
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best
  FROM eval_log)
SELECT run, step, round(metric, 6) AS metric, round(best, 6) AS best_before,
       (best IS NULL OR metric {sign} best) AS improved FROM b"""


STOPS = (
    EVAL_LOG
    + """, b AS (
  SELECT *, max(metric) OVER (PARTITION BY run ORDER BY step
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM eval_log
), islands AS (
  SELECT *, sum(CASE WHEN best IS NULL OR metric > best THEN 1 ELSE 0 END)
         OVER (PARTITION BY run ORDER BY step) AS island FROM b
), waits AS (
  SELECT *, row_number() OVER (PARTITION BY run, island ORDER BY step) - 1 AS waited
  FROM islands
), stops AS (
  SELECT run, min(CASE WHEN waited >= 25 THEN step END) AS stop_step FROM waits GROUP BY run
), until AS (
  SELECT w.run, w.step, w.metric, s.stop_step FROM waits w JOIN stops s ON s.run = w.run
  WHERE s.stop_step IS NULL OR w.step <= s.stop_step
), best AS (
  SELECT run, stop_step, step, metric, count(*) OVER (PARTITION BY run) AS n_evals,
         row_number() OVER (PARTITION BY run ORDER BY metric DESC, step) AS place
  FROM until)"""
)

HEX_VALUE = "('0x' || substr(md5('42:' || {key}), 1, 8))::BIGINT"


def split_name(key: str) -> str:
    number = HEX_VALUE.format(key=key)
    return (
        f"CASE WHEN {number} < round(0.8 * (1::BIGINT << 32)) THEN 'train' "
        f"WHEN {number} < round(0.9 * (1::BIGINT << 32)) THEN 'validation' ELSE 'test' END"
    )


def ranked_split(first: str, second: str) -> str:
    return f"""SELECT doc_id, CASE WHEN place <= {first} THEN 'train'
       WHEN place <= {second} THEN 'validation' ELSE 'test' END AS split
FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS place,
             count(*) OVER () AS n FROM documents)"""


VOCAB = f"""tokens AS (
  SELECT unnest({words("text")}) AS token FROM documents
), counts AS (
  SELECT token, count(*) AS n FROM tokens GROUP BY token
), vocab AS (
  SELECT (place + 2)::INTEGER AS id, token, n
  FROM (SELECT *, row_number() OVER (ORDER BY n DESC, token) AS place FROM counts)
  WHERE place <= 1997
  UNION ALL SELECT 0, '[PAD]', NULL UNION ALL SELECT 1, '[UNK]', NULL
  UNION ALL SELECT 2, '[END]', NULL)"""

ENCODED = VOCAB + f""", cut AS (
  SELECT doc_id, {words("text")}[1:128] AS toks FROM documents
), placed AS (
  SELECT doc_id, unnest(toks) AS token, unnest(range(1, len(toks) + 1)) AS pos FROM cut
), found AS (
  SELECT p.doc_id, p.pos, p.token, v.id AS known, coalesce(v.id, 1) AS id
  FROM placed p LEFT JOIN vocab v ON v.token = p.token
), encoded AS (
  SELECT c.doc_id, coalesce(l.ids, CAST([] AS INTEGER[])) AS ids
  FROM cut c LEFT JOIN (SELECT doc_id, list(id ORDER BY pos) AS ids FROM found
                        GROUP BY doc_id) l ON l.doc_id = c.doc_id)"""

PADDED = ENCODED + """, padded AS (
  SELECT doc_id,
         list_concat(ids[1:64], list_transform(range(0, 64 - least(len(ids), 64)),
                                               lambda x: 0)) AS input_ids,
         list_transform(range(1, 65),
                        lambda i: CASE WHEN i <= len(ids) THEN 1 ELSE 0 END) AS mask,
         list_transform(range(1, 65),
                        lambda i: CASE WHEN i <= len(ids) THEN ids[i] ELSE -100 END) AS labels
  FROM encoded)"""

# Whole documents, each filled up to the next multiple of 64 words.
PADDED_WHOLE = ENCODED.replace("[1:128]", "") + """, sized AS (
  SELECT *, greatest(64, ((len(ids) + 63) // 64) * 64) AS size FROM encoded
), padded AS (
  SELECT doc_id, size,
         list_concat(ids, list_transform(range(0, size - len(ids)), lambda x: 0)) AS input_ids,
         list_transform(range(1, size + 1),
                        lambda i: CASE WHEN i <= len(ids) THEN 1 ELSE 0 END) AS mask,
         list_transform(range(1, size + 1),
                        lambda i: CASE WHEN i <= len(ids) THEN ids[i] ELSE -100 END) AS labels
  FROM sized)"""


def _side(name: str, column: str, size: int) -> str:
    return f"""{name} AS (
  SELECT p.row_id, list(coalesce(v.id, 1) ORDER BY p.pos) AS ids
  FROM (SELECT row_id, unnest(toks) AS token, unnest(range(1, len(toks) + 1)) AS pos
        FROM (SELECT row_id, {words(column)}[1:{size}] AS toks FROM pairs)) p
  LEFT JOIN vocab v ON v.token = p.token GROUP BY p.row_id)"""


def _filled(ids: str, size: int, rest: str, value: str) -> str:
    return joined(
        f"list_transform(range(1, {size + 1}), "
        f"lambda i: CASE WHEN i <= coalesce(len({ids}), 0) THEN {value} ELSE {rest} END)"
    )


ENCODED_PAIRS = f"""WITH {VOCAB}, pairs AS ({curated("trimmed", KEPT, "oracle_text")}),
{_side("inputs", "input_text", 128)},
{_side("targets", "target_text", 64)}
SELECT pairs.row_id, {_filled("a.ids", 128, "0", "a.ids[i]")} AS input_ids,
       {_filled("a.ids", 128, "0", "1")} AS attention_mask,
       {_filled("b.ids", 64, "-100", "b.ids[i]")} AS labels
FROM pairs LEFT JOIN inputs a ON a.row_id = pairs.row_id
LEFT JOIN targets b ON b.row_id = pairs.row_id"""


def documents(expression: str, name: str) -> str:
    return f"SELECT doc_id, {expression} AS {name} FROM documents"


def cleaned_documents(expression: str, name: str) -> str:
    inner = f"(SELECT doc_id, {clean('text')} AS x FROM documents)"
    return f"SELECT doc_id, {expression} AS {name} FROM {inner}"


def named(label: str, x: str) -> str:
    return f"CASE WHEN {x} <> '' THEN '{label}: ' || {x} END"


def capitalized(x: str) -> str:
    name = x.capitalize()
    return f"CASE WHEN {x} IS NOT NULL THEN '{name}: ' || {clean_lower(x)} END"


X_SENTS = sentences("x")

ORACLES: dict[str, str] = {
    "clean_text": documents(clean("text"), "cleaned"),
    "clean_lower": documents(clean_lower("text"), "cleaned"),
    "clean_punct": documents(clean_punct("text"), "cleaned"),
    "normalize_label": f"WITH {RAW} SELECT row_id, {LABEL} AS label FROM raw_qa",
    "word_count": f"WITH {CLEANED} SELECT row_id, label_tokens FROM cleaned",
    "append_end": (
        f"WITH {CLEANED} SELECT row_id, rtrim(label) || ' [END]' AS target_text FROM cleaned"
    ),
    "word_tokens": documents(joined(words("text")), "tokens"),
    "rouge_tokens": documents(joined(rouge("text")), "tokens"),
    "stem_tokens": documents(joined(rouge_stems("text")), "tokens"),
    "stem_vocabulary": f"""SELECT token, {stems("[token]")}[1] AS stem, n FROM (
  SELECT token, count(*) AS n FROM (SELECT unnest({rouge("text")}) AS token FROM documents) GROUP BY token)""",
    "bleu_tokens_ws": documents(joined(bleu("text", "ws")), "tokens"),
    "bleu_tokens_13a": documents(joined(bleu("text", "13a")), "tokens"),
    "split_sentences": cleaned_documents(
        f"coalesce(array_to_string({X_SENTS}, chr(10)), '')", "sentences"
    ),
    "trim_sentences": cleaned_documents(
        f"coalesce(array_to_string({X_SENTS}[1:8], ' '), '')", "trimmed"
    ),
    "to_bullets": cleaned_documents(
        f"coalesce(array_to_string(list_transform({X_SENTS}[1:3], "
        "lambda s: '- ' || s), chr(10)), '')",
        "bullets",
    ),
    "token_set": documents(joined(f"list_sort(list_distinct({words('text')}))"), "tokens"),
    "overlap_ratio": (
        f"WITH {overlapped()} SELECT row_id, round(overlap, 6) AS overlap FROM overlapped"
    ),
    "eligible_sentences": f"""SELECT doc_id, (k - 1)::INTEGER AS idx, s[k] AS sent
FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS k
      FROM ({cleaned_documents(X_SENTS, "s")}))
WHERE {word_count("s[k]")} >= 5""",
    "ngrams_2": f"""SELECT doc_id, {joined(grams("t", 2))} AS grams
FROM ({documents(rouge("text"), "t")})""",
    "filter_label_len": f"""WITH {CLEANED} SELECT row_id, label, label_tokens
FROM cleaned WHERE label_tokens BETWEEN 5 AND 40""",
    "filter_overlap_trimmed": f"""WITH {overlapped()}
SELECT row_id, label, round(overlap, 6) AS overlap FROM overlapped WHERE overlap >= 0.45""",
    "filter_overlap_full": f"""WITH {overlapped("full")}
SELECT row_id, label, round(overlap, 6) AS overlap FROM overlapped WHERE overlap >= 0.45""",
    "filter_oracle": f"""WITH RECURSIVE {scored()}
SELECT row_id, oracle_text, round(oracle_score, 6) AS "oracle_rougeL" FROM scored
WHERE oracle_score >= 0.15 AND len(oracle_text) > 0""",
    "drop_report": f"""WITH RECURSIVE {scored()}, flagged AS (
  SELECT CASE WHEN label_tokens NOT BETWEEN 5 AND 40 THEN 1 WHEN overlap < 0.45 THEN 2
              WHEN oracle_score < 0.15 THEN 3 WHEN oracle_text = '' THEN 4 ELSE 0 END AS rule
  FROM scored)
SELECT count(*) AS rows_before, count(*) FILTER (rule = 0) AS rows_after,
       count(*) FILTER (rule > 0) AS dropped,
       count(*) FILTER (rule = 1) AS dropped_label_length,
       count(*) FILTER (rule = 2) AS dropped_overlap,
       count(*) FILTER (rule = 3) AS dropped_oracle_score,
       count(*) FILTER (rule = 4) AS dropped_oracle_text
FROM flagged""",
    "curate": curated("trimmed", KEPT, "oracle_text"),
    "curate_stemmed": curated("trimmed", KEPT, "oracle_text", stem=True),
    "curate_end_token": curated("trimmed", KEPT, "rtrim(oracle_text) || ' [END]'"),
    "curate_variant_oracle": curated("full", CHEAP, "oracle_text"),
    "curate_variant_label": curated("full", CHEAP, "label"),
    "curate_variant_bullets": curated("full", CHEAP, BULLETS),
    "oracle_reference": f"""WITH {CLEANED} SELECT row_id, label AS reference_label,
       query || ' ' || label AS reference_query_label, query AS reference_query_only
FROM cleaned""",
    "select_oracle": f"""WITH RECURSIVE {scored()}
SELECT row_id, oracle_text, round(oracle_score, 6) AS "oracle_rougeL" FROM scored""",
    "rouge_n": f"""WITH RECURSIVE {rouge_scores()}
SELECT row_id, round(rouge1, 6) AS rouge1, round(rouge2, 6) AS rouge2 FROM rouge_scores""",
    "lcs_length": f"""WITH RECURSIVE {rouge_scores()}
SELECT row_id, lcs::INTEGER AS lcs FROM rouge_scores""",
    "rouge_l": f"""WITH RECURSIVE {rouge_scores()}
SELECT row_id, round(rougel, 6) AS "rougeL" FROM rouge_scores""",
    "bleu_counts_ws": f"""WITH RECURSIVE {bleu_counts("ws")}
SELECT row_id, {COUNT_COLUMNS} FROM bleu_ws""",
    "bleu_counts_13a": f"""WITH RECURSIVE {bleu_counts("13a")}
SELECT row_id, {COUNT_COLUMNS} FROM bleu_13a""",
    "corpus_bleu_ws": f"""WITH RECURSIVE {bleu_counts("ws")}
SELECT run, round({bleu_score()}, 6) AS bleu
FROM (SELECT run, {SUMS} FROM bleu_ws GROUP BY run)""",
    "corpus_bleu_13a": f"""WITH RECURSIVE {bleu_counts("13a")}
SELECT run, round({bleu_score()}, 6) AS bleu
FROM (SELECT run, {SUMS} FROM bleu_13a GROUP BY run)""",
    "sentence_bleu": f"""WITH RECURSIVE {bleu_counts("ws")}
SELECT row_id, round({bleu_score()}, 6) AS bleu_score FROM bleu_ws""",
    "exact_match": f"""WITH RECURSIVE {PREDICTIONS}
SELECT run, round(avg((predicted = reference)::INTEGER), 6) AS exact_match
FROM predictions GROUP BY run""",
    "prompt_answer": f"""WITH {CLEANED} SELECT row_id, {answer("abstract")} AS input_text
FROM cleaned""",
    "prompt_columns": f"""WITH {CLEANED} SELECT row_id,
       concat_ws(' ', {named("Question", "query")}, {named("Title", "title")},
                 {named("Context", "abstract")}) AS input_text FROM cleaned""",
    "prompt_capitalized": f"""WITH {RAW} SELECT row_id,
       concat_ws(' ', {capitalized("query")}, {capitalized("title")},
                 {capitalized("abstract")}) AS input_text FROM raw_qa""",
    "prompt_inference": f"""WITH {RAW} SELECT row_id, 'Question: ' || {clean_lower("query")}
       || ' Context: ' || {clean_lower("abstract")} AS input_text FROM raw_qa""",
    "prompt_training": f"""WITH {RAW} SELECT row_id, 'Question: ' || {clean_punct("query")}
       || ' Context: Abstract: ' || {clean_punct("abstract")} AS input_text FROM raw_qa""",
    "prompt_summary": f"""WITH {SUMM} SELECT doc_id,
       'Instruction: Summarize the abstract in 1-2 sentences. Abstract: ' || source
         AS input_text, target AS target_text FROM summ""",
    "prompt_paraphrase": f"""WITH {CLEANED}
SELECT row_id, 'Paraphrase: ' || label AS input_text FROM cleaned""",
    "split_hash": f"SELECT doc_id, {split_name('doc_id')} AS split FROM documents",
    "split_exact": ranked_split(
        "n - ceil(round(n * 0.2, 6))", "n - ceil(round(ceil(round(n * 0.2, 6)) * 0.5, 6))"
    ),
    "split_floor": ranked_split("floor(n * 0.8)", "floor(n * 0.8) + floor(n * 0.1)"),
    "sample_review": f"""WITH {CLEANED}
SELECT row_id, query, label, '' AS quality_label, '' AS notes FROM cleaned
ORDER BY md5('13:' || row_id), row_id LIMIT 50""",
    "sample_sanity": f"""WITH {CLEANED}
SELECT row_id, label FROM cleaned WHERE {split_name("row_id")} = 'validation'
ORDER BY md5('13:' || row_id), row_id LIMIT 3""",
    "cap_per_group": f"""WITH {SUMM} SELECT doc_id, split
FROM (SELECT doc_id, split, row_number() OVER (PARTITION BY split
             ORDER BY md5('42:' || doc_id), doc_id) AS place FROM summ)
WHERE place <= 100""",
    "build_vocab": f"WITH {VOCAB} SELECT id, token, n FROM vocab",
    "encode": f"WITH {ENCODED} SELECT doc_id, {joined('ids')} AS ids FROM encoded",
    "pad": f"""WITH {PADDED} SELECT doc_id, {joined("input_ids")} AS ids,
       {joined("mask")} AS mask FROM padded""",
    "mask_labels": f"WITH {PADDED_WHOLE} SELECT doc_id, {joined('labels')} AS labels FROM padded",
    "encode_pairs": ENCODED_PAIRS,
    "decode": f"""WITH {VOCAB}, words AS (
  SELECT doc_id, unnest(toks) AS token, unnest(range(1, len(toks) + 1)) AS pos
  FROM (SELECT doc_id, {words("text")} AS toks FROM documents))
SELECT p.doc_id, coalesce(d.text, '') AS text
FROM documents p LEFT JOIN (
  SELECT w.doc_id, string_agg(w.token, ' ' ORDER BY w.pos) AS text
  FROM words w JOIN vocab v ON v.token = w.token WHERE v.id > 2
  GROUP BY w.doc_id) d ON d.doc_id = p.doc_id""",
    "argmax": """SELECT vec_id,
       (list_position(embedding, list_max(embedding)) - 1)::INTEGER AS best FROM embeddings""",
    "validate_encoded": f"""WITH {PADDED_WHOLE} SELECT count(*) AS n_rows,
       count(*) FILTER (len(input_ids) <> size OR len(mask) <> size OR len(labels) <> size)
         AS bad_length,
       count(*) FILTER (list_bool_or(list_transform(range(1, size + 1), lambda i:
         input_ids[i] = 0 AND mask[i] <> 0))) AS bad_mask,
       count(*) FILTER (list_bool_or(list_transform(range(1, size + 1), lambda i:
         (mask[i] = 0) <> (labels[i] = -100)))) AS bad_labels FROM padded""",
    "text_metrics": text_metrics(by_run=True),
    "text_metrics_total": text_metrics(by_run=False),
    "evaluate": evaluate(),
    "evaluate_saved": evaluate(),
    "score_rows": SCORE_ROWS,
    "evaluate_stemmed": evaluate(stem=True),
    "text_metrics_stemmed": text_metrics(by_run=True, stem=True),
    "mean_loss": f"""WITH {TRAIN_LOG}
SELECT run, step // 100 AS epoch, round(avg(loss), 6) AS mean_loss
FROM train_log GROUP BY 1, 2""",
    "latency_percentiles": """WITH m AS (
  SELECT event_type AS run, trunc(value * 1000000)::BIGINT AS v FROM events WHERE value IS NOT NULL
), b AS (
  SELECT run, CASE WHEN abs(v) < 256 THEN v
              ELSE sign(v) * (abs(v) - abs(v) % (1 << (length(bin(abs(v))) - 8))) END AS bucket, count(*) AS n
  FROM m GROUP BY 1, 2
), c AS (
  SELECT *, sum(n) OVER (PARTITION BY run ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY run) AS total FROM b)
SELECT run, max(total)::BIGINT AS n_runs, round(min(bucket) FILTER (upto * 100 >= total * 50) / 1000000, 6) AS p50,
       round(min(bucket) FILTER (upto * 100 >= total * 95) / 1000000, 6) AS p95 FROM c GROUP BY run""",
    "zip_by_position": """SELECT row_number() OVER (ORDER BY doc_id, md5(coalesce(text, ''))) - 1 AS position,
       doc_id::VARCHAR AS named, md5(coalesce(text, '')) AS digest FROM documents""",
    "metrics_log_repeated": f"""WITH {RUN_METRICS} SELECT 'run' || run AS run,
       unnest(['latency', 'rougeL']) AS metric, round(unnest([latency, rougel]), 6) AS value FROM run_metrics""",
    "latency_summary": """SELECT event_type AS run, round(avg(value), 6) AS avg_latency,
       count(value) AS n_runs FROM events GROUP BY 1""",
    "running_best": running_best(greater=True),
    "running_best_lower": running_best(greater=False),
    "early_stop": f"""WITH {STOPS} SELECT run, stop_step, n_evals,
       round(metric, 6) AS best_metric, step AS best_step FROM best WHERE place = 1""",
    "early_stop_stream": f"""WITH {STOPS} SELECT run, stop_step, n_evals,
       round(metric, 6) AS best_metric, step AS best_step FROM best WHERE place = 1""",
    "best_checkpoint": f"""WITH {STOPS}
SELECT run, step AS best_step, round(metric, 6) AS best_metric FROM best WHERE place = 1""",
    "step_profile": f"""WITH {TRAIN_LOG}, firsts AS (
  SELECT run, step, min(ts_s) AS ts FROM train_log GROUP BY 1, 2
), timed AS (
  SELECT run, step, coalesce(ts - lag(ts) OVER w, 0) / (step - coalesce(lag(step) OVER w, 0))
         AS seconds
  FROM firsts WINDOW w AS (PARTITION BY run ORDER BY step))
SELECT run, step, round(seconds, 4) AS step_time_sec,
       CASE WHEN seconds > 0 THEN round(1.0 / seconds, 4) END AS steps_per_sec
FROM timed WHERE step > 0""",
    "compare_runs": f"""WITH {LONG_METRICS}, wide AS (
  SELECT run, max(value) FILTER (metric = 'latency') AS lat,
         max(value) FILTER (metric = 'rougeL') AS rl FROM long_metrics GROUP BY run)
SELECT w.run, round(w.lat, 6) AS latency, round(w.rl, 6) AS "rougeL",
       round(w.lat / b.lat, 6) AS latency_ratio, round(w.rl / b.rl, 6) AS "rougeL_ratio"
FROM wide w, wide b WHERE b.run = 'config0_seed0'""",
    "seed_variance": f"""WITH {LONG_METRICS}
SELECT split_part(run, '_seed', 1) AS config, metric, count(value) AS n_runs,
       round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS stddev,
       round(min(value), 6) AS min, round(max(value), 6) AS max
FROM long_metrics GROUP BY 1, 2""",
    "pareto": f"""WITH {RUN_METRICS}
SELECT run, round(latency, 6) AS latency, round(rougel, 6) AS "rougeL" FROM run_metrics r
WHERE NOT EXISTS (SELECT 1 FROM run_metrics s
  WHERE s.latency <= r.latency AND s.rougel >= r.rougel
    AND (s.latency < r.latency OR s.rougel > r.rougel))""",
    "pareto_by_group": """WITH points AS (
  SELECT event_id, event_type, (user_id % 100)::DOUBLE AS latency, value FROM events
), tops AS (
  SELECT event_type, latency, max(value) AS top FROM points GROUP BY 1, 2
), front AS (
  SELECT event_type, latency, top, max(top) OVER (PARTITION BY event_type ORDER BY latency
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS faster FROM tops)
SELECT p.event_id, p.event_type, p.latency, p.value AS "rougeL"
FROM points p JOIN front f ON f.event_type = p.event_type AND f.latency = p.latency
  AND f.top = p.value WHERE f.faster IS NULL OR f.top > f.faster""",
    "zip_pairs": f"""WITH RECURSIVE {PREDICTIONS}
SELECT row_id, predicted, reference FROM predictions""",
    "append_column": f"""WITH RECURSIVE {bleu_counts("ws")}
SELECT r.row_id, b.bleu_score FROM raw_qa r LEFT JOIN (
  SELECT row_id, round({bleu_score()}, 6) AS bleu_score FROM bleu_ws) b USING (row_id)""",
    "stack_splits": f"WITH {SUMM} SELECT doc_id, target, split FROM summ",
    "batch_score": f"""WITH {CLEANED}
SELECT row_id, string_split(abstract, '. ')[1] AS prediction FROM cleaned""",
    "augment": f"""WITH {CLEANED} SELECT row_id, label AS target_text,
       string_split('Paraphrase: ' || label, '. ')[1] AS target_text_paraphrase FROM cleaned""",
    "score_pairs": f"""WITH RECURSIVE {PREDICTIONS} SELECT row_id,
       (len(reference) % 7)::DOUBLE AS entailment, (len(predicted) % 5)::DOUBLE AS neutral,
       (len(reference) = len(predicted))::INTEGER::DOUBLE AS contradiction FROM predictions""",
    "scores_to_columns": """SELECT doc_id AS row_id, quality::DOUBLE AS entailment,
       0.0::DOUBLE AS neutral, toxic::DOUBLE AS contradiction FROM labels""",
    "csv_round_trip": f"WITH {RAW} SELECT row_id, query, title, abstract, label FROM raw_qa",
    "csv_split_round_trip": f"WITH {RAW} SELECT row_id, query, title, abstract, label FROM raw_qa",
    "with_defaults": f"""WITH {RAW} SELECT row_id, coalesce(title, '') AS title,
       '' AS reference, 0.0::DOUBLE AS latency FROM raw_qa""",
    "read_lines": f"""SELECT input, count(*) AS n FROM (
  SELECT regexp_replace(line, '^[{WS}]+|[{WS}]+$', '', 'g') AS input
  FROM (SELECT unnest(string_split_regex(text, '\\r\\n|\\n|\\r')) AS line FROM documents))
WHERE input <> '' GROUP BY input""",
    "jsonl_round_trip": f"""WITH {SUMM} SELECT source,
       CASE WHEN doc_id % 7 <> 0 THEN target ELSE '' END AS target FROM summ""",
    "read_presplit": f"""WITH {SUMM} SELECT doc_id, nullif(target, '') AS target, split
FROM summ""",
    "read_run_metrics": read_metrics("accuracy", "speed", "absent"),
    "read_run_metrics_named": read_metrics("accuracy +1 [a]", "speed 50%20", "absent%"),
    "files_in_path": """SELECT ['A+b', 'a b', 'a%20B'][doc_id % 3 + 1] AS part, doc_id FROM documents""",
    "load_pairs_raw": f"""WITH {CLEANED} SELECT
       concat_ws(' ', {named("Question", "c.query")}, {named("Title", "c.title")},
                 {named("Context", "c.abstract")}) AS input_text,
       {clean("r.label")} AS target_text
FROM cleaned c JOIN raw_qa r ON r.row_id = c.row_id""",
    "load_pairs_ready": f"""WITH RECURSIVE {scored()}
SELECT {answer("abstract_trimmed")} AS input_text, oracle_text AS target_text
FROM scored WHERE {KEPT}""",
    "require_columns": f"WITH {RAW} SELECT row_id, query, label FROM raw_qa",
    "path_filter": f"WITH {SUMM} SELECT '' AS source, target FROM summ",
    "jsonl_by_step": f"""WITH RECURSIVE {PREDICTIONS}
SELECT row_id, predicted, reference, (row_id % 3)::INTEGER AS step FROM predictions""",
    "metrics_round_trip": f"""WITH {RUN_METRICS} SELECT run, round(latency, 6) AS latency,
       round(rougel, 6) AS "rougeL" FROM run_metrics""",
    "parquet_round_trip": f"WITH {SUMM} SELECT doc_id, target, split FROM summ",
    "metrics_log": f"""WITH {RUN_METRICS} SELECT 'run' || run AS run,
       CASE WHEN run % 2 = 0 THEN round(latency, 6) END AS latency,
       round(rougel, 6) AS "rougeL" FROM run_metrics""",
}
