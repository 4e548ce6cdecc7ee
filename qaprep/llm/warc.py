"""WARC derivatives: metadata and plain-text conversion records of responses.

Everything is computed inside the row of a response. Its two derivatives name
it in WARC-Refers-To and carry its target, date, digest and HTTP header.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of HTML, without lookaround so that any engine takes them.
DROPPED = (  # without its end, each of these reaches to the end of the page
    r"(?is)<!--.*?(?:-->|\z)|<script[^>]*>.*?(?:</script[^>]*>|\z)|<style[^>]*>.*?(?:</style[^>]*>|\z)"
    r"|<title[^>]*>.*?(?:</title[^>]*>|\z)"
)
BREAKS = (
    r"(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|header|footer|nav|body|html|head|blockquote|pre)"
    r"(?:[ \t\r\n\f/][^>]*)?>"
)
TAGS = r"<[^>]*>"
TITLE = r"(?is)<title[^>]*>(.*?)(?:</title[^>]*>|\z)"
LINK = r"(?is)<a[ \t\r\n\f][^>]*?href[ ]*=[ ]*[\x22']([^\x22'>]*)[\x22']"
LANGUAGE = r"(?is)<html[^>]*?lang[ ]*=[ ]*[\x22']([^\x22'>]*)[\x22']"
REFERENCE = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
#: Named references of HTML 4 and the apostrophe, from the standard library.
NAMED = name2codepoint | {"apos": 39}
# A space that does not break becomes a plain one, and the mark of
# byte order is no text.
SPACE, HARD_SPACE, BYTE_ORDER = 32, 160, 65279


def record_id(*parts: Column | str) -> Column:
    """A name-based URN that the same record gets in every run."""
    h = F.md5(F.concat_ws("|", *parts).cast("binary"))
    cuts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def digest(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content.cast("binary"), 256))


def octets(content: Column) -> Column:
    return F.octet_length(content).cast("long")


def unescaped(text: Column) -> Column:
    """Text with its character references resolved, each once.

    Decimal, hexadecimal and named ones count if they end in a semicolon. What
    names no character stays as it is.
    """
    known = F.create_map(*[F.lit(x) for name, code in sorted(NAMED.items()) for x in (name, code)])

    def resolved(piece: Column) -> Column:
        name = F.regexp_extract(piece, REFERENCE, 1)
        code = (
            F.when(name.rlike("^#[0-9]"), F.substring(name, 2, 7).cast("int"))
            .when(name.startswith("#"), F.conv(F.substring(name, 3, 6), 16, 10).cast("int"))
            .otherwise(F.try_element_at(known, name))
        )
        shown = F.when(code == HARD_SPACE, SPACE).otherwise(code)
        sign = F.when(code == BYTE_ORDER, "").otherwise(
            F.decode(F.unhex(F.lpad(F.hex(shown), 8, "0")), "UTF-32")
        )
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        rest = F.substring(piece, F.length(name) + 2, F.length(piece))
        return F.when(valid, F.concat(sign, rest)).otherwise(F.concat(F.lit("&"), piece))

    pieces = F.split(text, "&", -1)
    return F.array_join(F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(resolved(p))), "")


def plain_text(html: Column) -> Column:
    """Text of a page: block tags break lines, other tags and scripts go.

    A script, style, title or comment that does not end takes the rest of the page.
    """
    text = F.regexp_replace(html, DROPPED, "")
    text = F.regexp_replace(F.regexp_replace(text, BREAKS, "\n"), TAGS, "")
    text = F.regexp_replace(unescaped(text), r"[ \t\r\f\x0B]+", " ")
    text = F.regexp_replace(F.regexp_replace(text, r" ?\n ?", "\n"), r"\n+", "\n")
    return F.regexp_replace(text, r"^[ \n]+|[ \n]+$", "")


def responses(
    pages: DataFrame, url: str = "url", html: str = "html", id_column: str = "page_id", date: str | None = None
) -> DataFrame:
    """Response records of crawled pages: (source_id, record_id, target_uri,
    date, http_header, payload).

    NULL pages have an empty payload; without a column of dates they are NULL.
    Other columns of the pages are not read, whatever their names.
    """
    body = F.coalesce(F.col(html), F.lit(""))
    header = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        octets(body).cast("string"),
    )
    where = F.coalesce(F.col(url), F.lit(""))
    return pages.select(
        F.col(id_column).alias("source_id"),
        record_id(F.lit("response"), where, F.md5(body.cast("binary"))).alias("record_id"),
        F.col(url).alias("target_uri"),
        (F.col(date) if date else F.lit(None)).cast("string").alias("date"),
        header.alias("http_header"),
        body.alias("payload"),
    )


def derive(records: DataFrame) -> DataFrame:
    """Two rows for each response: its metadata and its conversion record.

    A response without id gets no derivative, since nothing could refer to it.
    NULL payloads and headers count as empty. Repeated responses give repeated
    derivatives with equal ids. Extra columns are not read.
    """
    payload = F.coalesce(F.col("payload"), F.lit(""))
    header = F.coalesce(F.col("http_header"), F.lit(""))
    links = F.transform(F.regexp_extract_all(payload, F.lit(LINK), F.lit(1)), unescaped)
    title = F.regexp_replace(unescaped(F.regexp_extract(payload, TITLE, 1)), r"[ \t\r\n\f]+", " ")
    fields = F.concat_ws(
        "\r\n",
        F.concat(F.lit("title: "), F.trim(title)),
        F.concat(F.lit("language: "), F.regexp_extract(payload, LANGUAGE, 1)),
        F.concat(F.lit("source-digest: "), digest(payload)),
        F.transform(links, lambda x: F.concat(F.lit("outlink: "), F.regexp_replace(x, r"[\r\n]+", ""))),
    )

    def record(kind: str, media: str, content: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("warc_type"), F.lit(media).alias("content_type"), content.alias("content")
        )

    both = F.array(
        record("metadata", "application/warc-fields", fields),
        record("conversion", "text/plain", plain_text(payload)),
    )
    return (
        records.where(F.col("record_id").isNotNull())
        .select(
            "source_id", F.col("record_id").alias("refers_to"), "target_uri", "date",
            header.alias("source_header"), digest(payload).alias("source_digest"),
            F.inline(both),
        )
        .select(
            "source_id", "warc_type", record_id(F.col("warc_type"), F.col("refers_to")).alias("record_id"),
            "refers_to", "target_uri", "date", "content_type", "source_header", "source_digest",
            digest(F.col("content")).alias("block_digest"), octets(F.col("content")).alias("content_length"),
            "content",
        )
    )


def record_text() -> Column:
    """A row of `derive` as a WARC/1.0 record; fields without value are left out.

    The header of the response stands in it line by line.
    """
    line = lambda name, c: F.concat(F.lit(f"{name}: "), F.regexp_replace(F.col(c).cast("string"), r"[\r\n]+", " "))
    header = F.filter(F.split("source_header", r"\r?\n"), lambda x: x != "")
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.0"), line("WARC-Type", "warc_type"), line("WARC-Record-ID", "record_id"),
        line("WARC-Refers-To", "refers_to"), line("WARC-Target-URI", "target_uri"), line("WARC-Date", "date"),
        line("WARC-Block-Digest", "block_digest"), line("X-Source-Payload-Digest", "source_digest"),
        F.transform(header, lambda x: F.concat(F.lit("X-Source-Header: "), x)),
        line("Content-Type", "content_type"), line("Content-Length", "content_length"),
    )
    return F.concat(head, F.lit("\r\n\r\n"), F.col("content"), F.lit("\r\n\r\n"))


def rendered(records: DataFrame) -> DataFrame:
    """(value): each derivative as a record, for a text sink."""
    return records.select(record_text().alias("value"))
