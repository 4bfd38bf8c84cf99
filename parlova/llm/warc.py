"""A content-addressed archive of web records. Spark SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlova.runtime import scratch_path

DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MIN_REVISIT_BYTES = 0
# A URL with control characters is written percent-encoded under a header line that says so.
_CONTROLS = [*range(0x20), 0x7F]
_CONTROL = r"[\x00-\x1F\x7F]"
_ESCAPED = "X-Target-URI-Escaped"
_HEX32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hex digits make four base32 digits."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), _HEX32, _BASE32)


def _line(name: str, value: Column) -> Column:
    """A header line, left out where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _escaped(url: Column) -> Column:
    """``url`` with % and control characters as %XX."""
    for code in (0x25, *_CONTROLS):
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return url


def _unescaped(url: Column) -> Column:
    for code in (*_CONTROLS, 0x25):
        url = F.replace(url, F.lit(f"%{code:02X}"), F.lit(chr(code)))
    return url


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def write_archive(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = MIN_REVISIT_BYTES
) -> None:
    """Write one record per row below ``path``: ``payloads`` once per content, ``records`` with headers.

    The payload is the text in UTF-8 (null: empty) or the bytes of a binary column. Its address is
    the SHA-256; SHA-1 and length must agree among all rows of an address, else writing fails. Of
    equal payloads of at least ``min_revisit_bytes`` the row with the largest id is a response and
    the others revisit it; repeated rows with that id are responses too. In a URL with line breaks or
    other control characters these and % are percent-encoded, and a header line says so, so
    that reading gives the URL as it was; a null URL has no header line. A
    null id never is the largest unless all are null. An empty table writes an empty archive. Payloads travel once, to be
    stored; headers follow the digest alone.
    """
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b""))
    raw = pages.select(
        F.col(f"`{id_col}`").cast("bigint").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload")
    )
    keyed = raw.withColumn("address", F.sha2("payload", 256))
    keyed.select("address", "payload").dropDuplicates(["address"]).write.parquet(f"{path}/payloads")
    slim = keyed.select(
        "page_id", "url", "address", base32_sha1(F.col("payload")).alias("digest"), F.octet_length("payload").cast("bigint").alias("n")
    )
    groups = slim.groupBy("address").agg(
        F.max("page_id").alias("holder"),
        F.min("digest").alias("d0"), F.max("digest").alias("d1"), F.min("n").alias("n0"), F.max("n").alias("n1"),
    )
    same = (F.col("d0") == F.col("d1")) & (F.col("n0") == F.col("n1"))
    groups = groups.select("address", F.when(same, F.col("holder")).otherwise(F.raise_error(F.lit("two payloads share a digest"))).alias("holder"))
    revisit = (F.col("n") >= min_revisit_bytes) & ~F.col("page_id").eqNullSafe(F.col("holder"))
    kind = F.when(revisit, "revisit").otherwise("response")
    escape = F.col("url").rlike(_CONTROL)
    url = F.when(escape, _escaped(F.col("url"))).otherwise(F.col("url"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), _line("Content-Length", F.col("n").cast("string")), F.lit("\r\n"))
    block = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("n"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", kind),
        _line("WARC-Record-ID", _record_id(F.col("page_id"))),
        _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Target-URI", url),
        _line(_ESCAPED, F.when(escape, F.lit("1"))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _line("WARC-Profile", F.when(revisit, PROFILE)),
        _line("WARC-Refers-To", F.when(revisit, _record_id(F.col("holder")))),
        F.lit("Content-Type: application/http;msgtype=response\r\n"),
        _line("Content-Length", block.cast("string")),
        F.lit("\r\n"),
    )
    slim.join(groups, "address").select(
        "address", header.cast("binary").alias("header"), http.cast("binary").alias("http")
    ).write.parquet(f"{path}/records")


def _field(name: str) -> Column:
    found = F.regexp_extract(F.col("_text"), f"\\r\\n{name}: ([^\\r\\n]*)\\r\\n", 1)
    return F.when(found != "", found)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records of an archive with their payloads put back.

    Columns: ``page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload,
    record``. A revisit gets the payload it refers to, and its ``record`` keeps headers only,
    as written. Stored bytes are checked against their address once, and each record's digest
    and lengths against its payload; a difference fails.
    """
    payloads = spark.read.parquet(f"{path}/payloads")
    whole = F.sha2("payload", 256) == F.col("address")
    payloads = payloads.select(
        "address",
        F.when(whole, F.col("payload")).otherwise(F.raise_error(F.lit("stored bytes differ from their address"))).alias("payload"),
        base32_sha1(F.col("payload")).alias("_digest"),
    )
    text = spark.read.parquet(f"{path}/records").withColumn("_text", F.col("header").cast("string"))
    # A field that is there but empty is an empty URL.
    uri = F.when(F.col("_text").contains("\r\nWARC-Target-URI: "), F.coalesce(_field("WARC-Target-URI"), F.lit("")))
    parsed = text.select(
        "address",
        "header",
        "http",
        _field("WARC-Type").alias("record_type"),
        F.regexp_extract(_field("WARC-Record-ID"), r"<urn:page:(-?\d+)>", 1).alias("_id"),
        F.regexp_extract(F.coalesce(_field("WARC-Refers-To"), F.lit("")), r"<urn:page:(-?\d+)>", 1).alias("_to"),
        F.when(F.col("_text").contains(f"\r\n{_ESCAPED}: "), _unescaped(uri)).otherwise(uri).alias("url"),
        F.regexp_extract(_field("WARC-Payload-Digest"), "sha1:(.*)", 1).alias("payload_digest"),
        _field("Content-Length").cast("bigint").alias("_length"),
    )
    back = parsed.join(payloads, "address")
    is_response = F.col("record_type") == "response"
    block = F.when(is_response, F.concat("http", "payload")).otherwise(F.col("http"))
    right = (F.col("payload_digest") == F.col("_digest")) & (F.octet_length(block) == F.col("_length"))
    record = F.concat(F.col("header"), block, F.lit(b"\r\n\r\n"))
    return back.select(
        F.when(F.col("_id") != "", F.col("_id").cast("bigint")).alias("page_id"),
        "url",
        "record_type",
        F.when(F.col("_to") != "", F.col("_to").cast("bigint")).alias("refers_to"),
        "payload_digest",
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        "payload",
        F.when(right, record).otherwise(F.raise_error(F.lit("a record does not fit its payload"))).alias("record"),
    )


def op1_warc(spark, sf_dir: str) -> DataFrame:
    """Archive all ``pages`` and read the records back."""
    path = scratch_path(spark, "archive")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archive(spark, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.sha2("record", 256).alias("record_sha256")
    )


def _sql_line(name: str, value: str) -> str:
    return f"coalesce('{name}: ' || {value} || chr(13) || chr(10), '')"


def _sql_escaped(url: str) -> str:
    for code in (0x25, *_CONTROLS):
        url = f"replace({url}, chr({code}), '%{code:02X}')"
    return url


SQL = f"""
WITH p AS (
  SELECT page_id, regexp_matches(url, '{_CONTROL}') AS escape, CASE WHEN regexp_matches(url, '{_CONTROL}') THEN {_sql_escaped("url")} ELSE url END AS url, coalesce(html, '') AS payload FROM pages
), k AS (
  SELECT *, octet_length(encode(payload)) AS n, sha1(payload) AS hex, max(page_id) OVER (PARTITION BY payload) AS holder FROM p
), d AS (
  SELECT *, page_id IS DISTINCT FROM holder AS again, chr(13) || chr(10) AS crlf,
    translate(list_aggregate(list_transform(range(8), lambda i: lpad(upper(to_base(CAST('0x' || substr(hex, CAST(1 + 5 * i AS INT), 5) AS BIGINT), 32)), 4, '0')), 'string_agg', ''),
      '{_HEX32}', '{_BASE32}') AS payload_digest
  FROM k
), h AS (
  SELECT *, 'HTTP/1.1 200 OK' || crlf || 'Content-Type: text/html; charset=utf-8' || crlf || 'Content-Length: ' || n || crlf || crlf AS http,
    CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type FROM d
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, payload_digest, record_type, CASE WHEN again THEN holder END AS refers_to,
  sha256('WARC/1.1' || crlf || {_sql_line("WARC-Type", "record_type")} || {_sql_line("WARC-Record-ID", "'<urn:page:' || page_id || '>'")}
    || {_sql_line("WARC-Date", f"'{DATE}'")} || {_sql_line("WARC-Target-URI", "url")} || {_sql_line(_ESCAPED, "CASE WHEN escape THEN '1' END")} || {_sql_line("WARC-Payload-Digest", "'sha1:' || payload_digest")}
    || {_sql_line("WARC-Profile", f"CASE WHEN again THEN '{PROFILE}' END")} || {_sql_line("WARC-Refers-To", "CASE WHEN again THEN '<urn:page:' || holder || '>' END")}
    || 'Content-Type: application/http;msgtype=response' || crlf
    || {_sql_line("Content-Length", "(length(http) + CASE WHEN again THEN 0 ELSE n END)")} || crlf
    || http || CASE WHEN again THEN '' ELSE payload END || crlf || crlf) AS record_sha256
FROM h"""
