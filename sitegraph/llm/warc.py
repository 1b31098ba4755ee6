"""WARC derivatives: responses to linked metadata and plain-text conversion records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegraph.functions.entities import convert_entities
from sitegraph.functions.once import once
from sitegraph.llm.common import table

#: the instant that records without a date of their own get
DATE = "2024-01-15T12:00:00Z"
_END = "\r\n"
#: elements whose end or beginning starts a new line of text
_LINES = "p|div|br|li|ul|ol|tr|table|h[1-6]|article|section|header|footer|nav|title|body|html|head|blockquote|pre"

#: an attribute, passed whole so that nothing inside a quoted value counts
_ATTRIBUTE = r"""(?:[^\s"'>=<][^\s>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+|(?=>)))?+|["'=<])"""
_BETWEEN = r"""(?:[\s/]++|(?<=["']))"""
#: an anchor up to the value of its first ``href``, which has double, single or no quotes
_HREF = rf"""(?i)<a(?=[\s/])(?:{_BETWEEN}(?!href\s*+=){_ATTRIBUTE})*+{_BETWEEN}href\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)"""


def urn(*parts: Column) -> Column:
    """A record identifier that depends on the parts alone, so that reruns agree."""
    h = F.md5(F.concat_ws("\n", *parts))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.encode(text, "UTF-8"), 256))


#: the rest of a tag up to its end, which is not inside quotes where these are closed
_REST = r"""(?:(?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+>)"""
#: what a reader does not see: scripts, styles and comments, up to the end where they are not closed
_HIDDEN = rf"(?is)<script\b{_REST}.*?(?:</script\s*>|\z)|<style\b{_REST}.*?(?:</style\s*>|\z)|<!--.*?(?:-->|\z)"


def visible(html: Column) -> Column:
    return F.regexp_replace(html, _HIDDEN, " ")


def without_markup(shown: Column) -> Column:
    """Tags go; block elements end lines. Takes what ``visible`` leaves."""
    text = F.regexp_replace(shown, r"[\r\n]+", " ")
    text = F.regexp_replace(text, rf"(?i)</?(?:{_LINES})\b{_REST}", "\n")
    return F.regexp_replace(text, f"<{_REST}", "")


def plain_text(bare: Column) -> Column:
    """Entities to characters; blanks run together, and so do empty lines."""
    text = convert_entities(bare, "html")
    # single blanks, the most, are not matched
    text = F.regexp_replace(text, r"[ \t]{2,}|\t", " ")
    text = F.replace(F.regexp_replace(text, r"\n[ \n]++", "\n"), F.lit(" \n"), F.lit("\n"))
    return F.btrim(text, F.lit(" \n"))


def record(headers: list[tuple[str, Column]], block: Column) -> Column:
    """A whole record: version, named fields (those with a value), an empty line, the block and its end."""
    lines = [F.when(v.isNotNull() & (v != ""), F.concat(F.lit(f"{k}: "), v, F.lit(_END))).otherwise("") for k, v in headers]
    return F.concat(F.lit(f"WARC/1.1{_END}"), *lines, F.lit(_END), block, F.lit(_END * 2))


def as_responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Pages as response records: ``record_id, target_uri, date, http, body``."""
    body = F.coalesce(F.col("html"), F.lit(""))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}Content-Length: "),
                    F.octet_length(body).cast("string"), F.lit(_END * 2))
    uri = F.coalesce(F.col("url"), F.lit(""))
    return pages.select("page_id", urn(F.lit("response"), uri, F.lit(date), F.sha2(body, 256)).alias("record_id"),
                        uri.alias("target_uri"), F.lit(date).alias("date"), http.alias("http"), body.alias("body"))


def outlinks(html: Column) -> Column:
    """The ``href`` of every anchor of a ``visible`` page that has one, without quotes, entities to characters, on one line."""
    def url(value: Column) -> Column:
        quoted = value.startswith('"') | value.startswith("'")
        bare = F.when(quoted, F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)
        return F.regexp_replace(convert_entities(bare, "xhtml"), r"[\r\n]", "")

    return F.transform(F.regexp_extract_all(html, F.lit(_HREF), F.lit(1)), url)


def http_field(http: Column, name: str) -> Column:
    """A field of a header block, by its name in any case; empty where it is missing."""
    return F.regexp_extract(http, rf"(?im)^{name}:[ \t]*([^\r\n]*?)[ \t]*\r?$", 1)


def derive(responses: DataFrame, *keep: str) -> DataFrame:
    """Two records per response: ``kind, record_id, refers_to, target_uri, block_digest, length, record``.

    ``responses(record_id, target_uri, date, http, body)``: ``http`` is the header
    block with the status line, ``body`` its decoded payload. A ``metadata`` record
    (``application/warc-fields``) gives the source's status, headers, length and
    digest and its links; a ``conversion`` record is the page's plain text. Both
    refer to the response by its identifier and to each other
    (``WARC-Concurrent-To``), and keep its target and date. ``keep`` names more
    columns to return (not one of the names made here).

    Null and empty bodies give an empty text, a null target no target field, a
    null header block empty source fields; a null identifier is replaced by one
    from the other columns. Rows that repeat give equal records, as often. An
    empty table gives no rows. Other columns are not looked at. Identifiers and
    digests depend on the content only.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    r = responses.select(*keep, "record_id", text("target_uri").alias("uri"), text("date").alias("date"), text("http").alias("http"), text("body").alias("body"))
    r = r.withColumn("source", F.coalesce("record_id", urn(F.lit("response"), "uri", "date", "http", "body"))).drop("record_id")
    # each of these is used in several fields, and computed once
    r = once(r, {"said": digest(F.col("body")), "shown": visible(F.col("body"))})
    r = once(r, {"bare": without_markup(F.col("shown"))})
    r = once(r, {"text": plain_text(F.col("bare"))})
    links = F.array_join(F.transform(outlinks(F.col("shown")), lambda u: F.concat(F.lit("outlink: "), u, F.lit(_END))), "")
    status = F.regexp_extract("http", r"^HTTP/[0-9.]+ ([0-9]+)", 1)
    fields = F.concat(*[F.concat(F.lit(f"{k}: "), v, F.lit(_END)) for k, v in (
        ("source-status", status), ("source-content-type", http_field(F.col("http"), "content-type")),
        ("source-headers-digest", digest(F.col("http"))), ("source-payload-digest", F.col("said")),
        ("source-payload-length", F.octet_length("body").cast("string")))], links)

    ids = {k: urn(F.lit(k), F.col("source"), F.col("said")) for k in ("metadata", "conversion")}
    r = once(r, {"fields": fields, **{f"{k}_id": v for k, v in ids.items()}})
    # a row per record, with its block and what differs
    kinds = F.inline(F.array(
        F.struct(F.lit("metadata").alias("kind"), F.col("metadata_id").alias("record_id"), F.col("conversion_id").alias("other"),
                 F.col("fields").alias("block"), F.lit("application/warc-fields").alias("content"), F.lit("").alias("payload")),
        F.struct(F.lit("conversion").alias("kind"), F.col("conversion_id").alias("record_id"), F.col("metadata_id").alias("other"),
                 F.col("text").alias("block"), F.lit("text/plain; charset=utf-8").alias("content"), F.col("said").alias("payload"))))
    r = once(r.select(*keep, "source", "uri", "date", kinds), {"block_digest": digest(F.col("block"))})
    length = F.octet_length("block")
    head = [("WARC-Type", F.col("kind")), ("WARC-Record-ID", F.col("record_id")), ("WARC-Refers-To", F.col("source")),
            ("WARC-Concurrent-To", F.col("other")), ("WARC-Target-URI", F.col("uri")), ("WARC-Date", F.col("date")),
            ("WARC-Source-Payload-Digest", F.col("payload")), ("WARC-Block-Digest", F.col("block_digest")),
            ("Content-Type", F.col("content")), ("Content-Length", length.cast("string"))]
    return r.select(*keep, "kind", "record_id", F.col("source").alias("refers_to"), F.col("uri").alias("target_uri"), "block_digest",
                    length.cast("bigint").alias("length"), record(head, F.col("block")).alias("record"))


def op10_warc_derivatives(spark: SparkSession, sf: str) -> DataFrame:
    """All pages, as responses, to metadata and conversion records."""
    return derive(as_responses(table(spark, sf, "pages")), "page_id")


def _urn_sql(*parts: str) -> str:
    h = f"md5(concat_ws(chr(10), {', '.join(parts)}))"
    return f"'<urn:uuid:' || {h}[1:8] || '-' || {h}[9:12] || '-' || {h}[13:16] || '-' || {h}[17:20] || '-' || {h}[21:32] || '>'"


_N = "chr(13) || chr(10)"

# the same without possessive quantifiers, which only save going back
_SQL_REST, _SQL_HIDDEN = (x.replace("'", "''").replace("++", "").replace("*+", "*") for x in (_REST, _HIDDEN))

OP10_SQL = rf"""
WITH src AS (
  SELECT page_id, coalesce(url, '') AS uri, coalesce(html, '') AS body,
    'HTTP/1.1 200 OK' || {_N} || 'Content-Type: text/html; charset=utf-8' || {_N} || 'Content-Length: ' || octet_length(encode(coalesce(html, ''))) || {_N} || {_N} AS http
  FROM pages),
named AS (
  SELECT *, {_urn_sql("'response'", "uri", f"'{DATE}'", "sha256(body)")} AS source, 'sha256:' || sha256(body) AS said,
    regexp_replace(body, '{_SQL_HIDDEN}', ' ', 'g') AS shown
  FROM src),
bared AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(shown, '[\r\n]+', ' ', 'g'),
      '(?i)</?(?:{_LINES})\b{_SQL_REST}', chr(10), 'g'), '<{_SQL_REST}', '', 'g') AS t,
    list_filter(list_transform(regexp_extract_all(shown, '(?i)<a[\s/]{_SQL_REST}'),
      lambda a: regexp_extract(a, '(?i)[\s/"'']href\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>][^\s>]*)', 1)), lambda h: h <> '') AS hrefs
  FROM named),
texts AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(
      replace(replace(replace(replace(replace(replace(t, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'),
      '[ \t]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g') AS text,
    'source-status: 200' || {_N} || 'source-content-type: text/html; charset=utf-8' || {_N} || 'source-headers-digest: sha256:' || sha256(http) || {_N}
      || 'source-payload-digest: ' || said || {_N} || 'source-payload-length: ' || octet_length(encode(body)) || {_N}
      || array_to_string(list_transform(hrefs, lambda h: 'outlink: ' || replace(replace(replace(replace(
           CASE WHEN h[1] IN ('"', chr(39)) THEN h[2:-2] ELSE h END, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') || {_N}), '') AS fields,
    {_urn_sql("'metadata'", "source", "said")} AS meta_id, {_urn_sql("'conversion'", "source", "said")} AS conv_id
  FROM bared),
made AS (
  SELECT page_id, 'metadata' AS kind, meta_id AS record_id, conv_id AS other, source, uri, said, fields AS block, 'application/warc-fields' AS content FROM texts
  UNION ALL SELECT page_id, 'conversion', conv_id, meta_id, source, uri, said, text, 'text/plain; charset=utf-8' FROM texts)
SELECT page_id, kind, record_id, source AS refers_to, uri AS target_uri, 'sha256:' || sha256(block) AS block_digest,
  CAST(octet_length(encode(block)) AS BIGINT) AS length,
  'WARC/1.1' || {_N} || 'WARC-Type: ' || kind || {_N} || 'WARC-Record-ID: ' || record_id || {_N} || 'WARC-Refers-To: ' || source || {_N}
    || 'WARC-Concurrent-To: ' || other || {_N} || CASE WHEN uri <> '' THEN 'WARC-Target-URI: ' || uri || {_N} ELSE '' END || 'WARC-Date: {DATE}' || {_N}
    || CASE WHEN kind = 'conversion' THEN 'WARC-Source-Payload-Digest: ' || said || {_N} ELSE '' END
    || 'WARC-Block-Digest: sha256:' || sha256(block) || {_N} || 'Content-Type: ' || content || {_N} || 'Content-Length: ' || octet_length(encode(block)) || {_N}
    || {_N} || block || {_N} || {_N} AS record
FROM made
"""
