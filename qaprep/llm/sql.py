"""SQL counterparts of the queries that SQL can express.

The learned operators, 64-bit shingle hashes and tokens have none; tests hold
them against plain Python, the tokenizers library and held-out labels. Sketches
are counts by bucket, so the quality rules have one.
"""

from __future__ import annotations

from qaprep.llm import rules, warc


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _every(text: str, pattern: str, by: str) -> str:
    return f"regexp_replace({text}, {_quoted(pattern)}, {by}, 'g')"


def _urn(*parts: str) -> str:
    h = f"md5(concat_ws('|', {', '.join(parts)}))"
    cuts = [f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return f"'<urn:uuid:' || concat_ws('-', {', '.join(cuts)}) || '>'"


def _unescaped(text: str) -> str:
    """References are taken piece by piece between ampersands."""
    known = "MAP {" + ", ".join(f"'{name}': {code}" for name, code in sorted(warc.NAMED.items())) + "}"
    name = f"regexp_extract(p, {_quoted(warc.REFERENCE)}, 1)"
    code = (
        f"CASE WHEN {name} = '' THEN NULL WHEN regexp_matches({name}, '^#[0-9]') THEN substr({name}, 2)::INT "
        f"WHEN {name}[1] = '#' THEN ('0x' || substr({name}, 3))::INT ELSE ({known})[{name}] END"
    )
    sign = (
        f"CASE {code} WHEN {warc.HARD_SPACE} THEN chr({warc.SPACE}) WHEN {warc.BYTE_ORDER} THEN '' "
        f"ELSE chr({code}) END"
    )
    valid = f"({code} BETWEEN 1 AND 55295 OR {code} BETWEEN 57344 AND 1114111)"
    resolved = f"CASE WHEN {valid} THEN {sign} || substr(p, length({name}) + 2) ELSE '&' || p END"
    pieces = f"string_split({text}, '&')"
    return f"array_to_string(list_transform({pieces}, lambda p, i: CASE WHEN i = 1 THEN p ELSE {resolved} END), '')"


def _warc() -> str:
    crlf = "chr(13) || chr(10)"
    text = _every("payload", warc.DROPPED, "''")
    text = _every(_every(text, warc.BREAKS, "chr(10)"), warc.TAGS, "''")
    text = _every(_unescaped(text), r"[ \t\r\f\x0B]+", "' '")
    text = _every(_every(text, r" ?\n ?", "chr(10)"), r"\n+", "chr(10)")
    text = _every(text, r"^[ \n]+|[ \n]+$", "''")
    title = f"trim({_every(_unescaped(f'regexp_extract(payload, {_quoted(warc.TITLE)}, 1)'), r'[ \t\r\n\f]+', _quoted(' '))})"
    links = f"regexp_extract_all(payload, {_quoted(warc.LINK)}, 1)"
    out = f"list_transform({links}, lambda x: {crlf} || 'outlink: ' || {_every(_unescaped('x'), r'[\r\n]+', _quoted(''))})"
    fields = (
        f"'title: ' || {title} || {crlf} || 'language: ' || regexp_extract(payload, {_quoted(warc.LANGUAGE)}, 1)"
        f" || {crlf} || 'source-digest: ' || source_digest || array_to_string({out}, '')"
    )
    header = f"list_transform(list_filter(string_split(source_header, {crlf}), lambda x: x <> ''), lambda x: 'X-Source-Header: ' || x)"
    record = f"""concat_ws({crlf}, 'WARC/1.0', 'WARC-Type: ' || warc_type,
    'WARC-Record-ID: ' || {_urn("warc_type", "refers_to")}, 'WARC-Refers-To: ' || refers_to,
    'WARC-Target-URI: ' || {_every("url", r"[\r\n]+", "' '")},
    'WARC-Block-Digest: sha256:' || sha256(content), 'X-Source-Payload-Digest: ' || source_digest,
    array_to_string({header}, {crlf}), 'Content-Type: ' || content_type,
    'Content-Length: ' || octet_length(encode(content)), '', content, '', '')"""
    return f"""
WITH page AS (
  SELECT page_id, url, coalesce(html, '') AS payload FROM pages
), response AS (
  SELECT *, {_urn("'response'", "coalesce(url, '')", "md5(payload)")} AS refers_to,
    'HTTP/1.1 200 OK' || {crlf} || 'Content-Type: text/html; charset=utf-8' || {crlf}
      || 'Content-Length: ' || octet_length(encode(payload)) AS source_header,
    'sha256:' || sha256(payload) AS source_digest
  FROM page
), derived AS (
  SELECT *, 'metadata' AS warc_type, 'application/warc-fields' AS content_type, {fields} AS content FROM response
  UNION ALL
  SELECT *, 'conversion', 'text/plain', {text} FROM response
)
SELECT page_id, warc_type, {_urn("warc_type", "refers_to")} AS record_id, refers_to, url AS target_uri,
  NULL::VARCHAR AS date, content_type, source_header, source_digest,
  'sha256:' || sha256(content) AS block_digest, octet_length(encode(content))::BIGINT AS content_length, content,
  'sha256:' || sha256({record}) AS record_digest
FROM derived"""


def _rules() -> str:
    word = r"[^\x20\x09-\x0D]"
    size = lambda sign: f"length(regexp_replace(body, '[^{sign}]', '', 'g'))"
    rates = ", ".join(
        f"floor({f} * {a} / greatest({b}, 1))::BIGINT AS {k}" for k, (a, b, f) in rules.SHARES.items()
    )
    rows = " UNION ALL ".join(
        f"SELECT row, lang, source, base_failed, {i} AS place, '{k}' AS rate, {k} AS value, "
        f"{rules.RATES[k][0]} AS low_too, {rules.RATES[k][1]} AS level, "
        f"{f} * ({a} - {rules.SPARED}) AS least, {f} * ({a} + {rules.SPARED}) AS most, greatest({b}, 1) AS size FROM counted"
        for i, (k, (a, b, f)) in enumerate(rules.SHARES.items())
    )
    pieces = rules.BLENDED * rules.PARTS

    def spread_like(table: str, keys: str) -> str:
        return f"""
  SELECT {keys}rate, level, bucket, upto * {pieces} // total - (upto - n) * {pieces} // total AS n FROM (
    SELECT *, sum(n) OVER (PARTITION BY {keys}rate ORDER BY bucket)::BIGINT AS upto,
      sum(n) OVER (PARTITION BY {keys}rate)::BIGINT AS total
    FROM {table}
  )"""

    def quantile(share: str) -> str:
        return f"min(CASE WHEN upto * 100 >= total * ({share}) THEN bucket END)"

    return f"""
WITH given AS (
  SELECT row_number() OVER () AS row, doc_id, lang, source, coalesce(text, '') AS body FROM documents
), parted AS (
  SELECT *, regexp_extract_all(body, '{word}+') AS words,
    list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '{word}')) AS lines
  FROM given
), windows AS (
  SELECT row, place, count(*) OVER (PARTITION BY row, text) AS n FROM (
    SELECT row, unnest(range(1, len(words) - {rules.WINDOW - 2})) AS place,
      unnest(list_transform(range(1, len(words) - {rules.WINDOW - 2}),
        lambda i: array_to_string(words[i:i + {rules.WINDOW - 1}], ' '))) AS text
    FROM parted
  )
), repeats AS (
  SELECT row, count(DISTINCT place + step) AS n_repeat_words
  FROM windows, range({rules.WINDOW}) AS steps(step) WHERE n > 1 GROUP BY row
), counts AS (
  SELECT row, doc_id, lang, source, len(words)::BIGINT AS n_words,
    length(array_to_string(words, ''))::BIGINT AS word_chars, {size("#*$%&|<>")}::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    len(lines) AS n_lines, {size("!?")} AS n_marks, {size("A-Z")} AS n_upper
  FROM parted LEFT JOIN repeats USING (row)
), counted AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {rates} FROM counts
), rated AS (
  SELECT *, CASE WHEN value < 64 THEN value ELSE value - value % (1 << (length(bin(value)) - 6)) END AS bucket
  FROM ({rows})
), sketch AS (
  SELECT lang, source, rate, level, bucket, count(*) AS n FROM rated WHERE NOT base_failed GROUP BY ALL
), by_lang AS (
  SELECT lang, rate, level, bucket, sum(n)::BIGINT AS n FROM sketch GROUP BY ALL
), corpus AS (
  SELECT rate, level, bucket, sum(n)::BIGINT AS n FROM sketch GROUP BY ALL
), corpus_part AS ({spread_like("corpus", "")}
), tongue AS (
  SELECT lang, rate, level, bucket, sum(n)::BIGINT AS n FROM (
    SELECT lang, rate, level, bucket, n * {rules.PARTS} AS n FROM by_lang
    UNION ALL
    SELECT lang, rate, level, bucket, n FROM (SELECT DISTINCT lang, rate FROM by_lang) JOIN corpus_part USING (rate)
  ) GROUP BY ALL
), tongue_part AS ({spread_like("tongue", "lang, ")}
), own AS (
  SELECT lang, source, rate, level, bucket, sum(n)::BIGINT AS n FROM (
    SELECT lang, source, rate, level, bucket, n * {rules.PARTS} AS n FROM sketch
    UNION ALL
    SELECT g.lang, source, g.rate, level, bucket, n
    FROM (SELECT DISTINCT lang, source, rate FROM sketch) g
    JOIN tongue_part t ON g.lang IS NOT DISTINCT FROM t.lang AND g.rate = t.rate
  ) GROUP BY ALL
), quantiles AS (
  SELECT lang, source, rate, {quantile("100 - level")} AS few, {quantile("50")} AS middle, {quantile("level")} AS many
  FROM (
    SELECT *, sum(n) OVER (PARTITION BY lang, source, rate ORDER BY bucket) AS upto,
      sum(n) OVER (PARTITION BY lang, source, rate) AS total
    FROM own
  ) GROUP BY lang, source, rate
), judged AS (
  SELECT r.row, string_agg(r.rate, ',' ORDER BY place) AS failed_rules
  FROM rated r JOIN quantiles c
    ON r.lang IS NOT DISTINCT FROM c.lang AND r.source IS NOT DISTINCT FROM c.source AND r.rate = c.rate
  WHERE least > (many + {rules.REACH} * (many - middle)) * size
    OR (low_too AND most < (few - {rules.REACH} * (middle - few)) * size)
  GROUP BY r.row
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND failed_rules IS NULL AS kept, coalesce(failed_rules, '') AS failed_rules
FROM counted LEFT JOIN judged USING (row)"""


ORACLES: dict[str, str] = {"op5_rules": _rules(), "op10_warc": _warc()}
