"""WARC archives: records with revisits, and boundary-chain verified reading.

Reading does not trust the record magic: payloads may hold it. Tasks emit every
candidate record with the offset at which its successor must start; for each
file pointer jumping from its start then keeps the candidates that the chain
of successors reaches, and drops those inside payloads.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fabula.session import cut, new_folder

END = "\r\n\r\n"
DATE = "2020-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The magic counts at the start of a line; no field of a header begins so.
MAGIC = re.compile(rb"(?:\A|(?<=\r\n))WARC/1\.[01]\r\n")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORDS_PER_FILE = 1000
#: Bytes of a record of which a file takes that many; of records of up to
#: twice the bytes it takes half as many, and so on.
RECORD_BYTES = 128 << 10
FIELD = re.compile(rb"\r\n([!-9;-~]+)[ \t]*:[ \t]*([^\r\n]*)")
NUMBER = re.compile(r"[0-9]{1,18}")


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 5 hex digits are 4 letters."""
    digest = F.sha1(payload)

    def letters(i: Column) -> Column:
        five = F.conv(F.substring(digest, i * 5 + 1, F.lit(5)), 16, 10).cast("int")
        return F.concat(*[F.substring(F.lit(ALPHABET), F.shiftright(five, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)])

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), letters), "")


def with_revisits(pages: DataFrame, *, least_bytes: int = 0) -> DataFrame:
    """payload, payload_bytes, payload_digest, record_type and refers_to added.

    Of rows with equal payloads of at least ``least_bytes``, those with the
    smallest page_id are responses and the others revisit it; smaller payloads
    are all responses. A null html is the empty payload. Rows without a page_id
    revisit like others and are responses where no row of their group has one.
    """
    carried = [c for c in pages.columns if c == "_class"]
    keyed = pages.select(
        "page_id", "url", *carried, F.coalesce("html", F.lit("")).alias("payload"), F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("payload_bytes")
    ).withColumn("payload_digest", base32_sha1(F.col("payload").cast("binary")))
    # Groups of one need no partner: only ids and digests of copies are joined.
    first = cut(
        keyed.where(F.col("payload_bytes") >= least_bytes)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select(F.col("payload_digest").alias("_digest"), "first")
    )
    again = F.coalesce(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id")), F.lit(False))
    return keyed.join(first, (F.col("payload_digest") == F.col("_digest")) & (F.col("payload_bytes") >= least_bytes), "left").select(
        "page_id",
        "url",
        *carried,
        "payload",
        "payload_bytes",
        "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first")).alias("refers_to"),
    )


def record_text(r: DataFrame) -> DataFrame:
    """One string per record, without the closing blank lines."""
    uri = F.coalesce(F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", ""), F.lit("\r\n")), F.lit(""))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    revisit = F.col("record_type") == "revisit"
    refers = F.when(
        revisit, F.concat(F.lit("WARC-Refers-To: "), name("refers_to"), F.lit(f"\r\nWARC-Profile: {PROFILE}\r\n"))
    ).otherwise("")
    block = F.when(revisit, F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), "payload"))
    length = F.lit(len(HTTP)) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    return r.select(
        F.concat(
            F.lit("WARC/1.0\r\nWARC-Type: "), "record_type", F.lit("\r\nWARC-Record-ID: "), name("page_id"), F.lit("\r\n"), uri,
            F.lit(f"WARC-Date: {DATE}\r\nWARC-Payload-Digest: sha1:"), "payload_digest", F.lit("\r\n"), refers,
            F.lit("X-Payload-Length: "), F.col("payload_bytes").cast("string"),
            F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), length.cast("string"), F.lit("\r\n\r\n"), block,
        ).alias("value")
    )


def size_class(pages: DataFrame) -> Column:
    """0 for records of up to RECORD_BYTES, k for up to 2**k times that."""
    size = F.coalesce(F.octet_length("html"), F.lit(0)).cast("long") + F.coalesce(F.octet_length("url"), F.lit(0)) + 1024
    return F.greatest(F.ceil(F.log2(size / RECORD_BYTES)), F.lit(0)).cast("int")


def write_archives(pages: DataFrame, path: str, *, least_bytes: int = 0, compression: str = "gzip") -> None:
    """Writes archives; Spark's text sink ends each record with the two line
    ends that the format asks for, and commits whole files only. compression:
    ``gzip`` for one member a file, ``none`` for archives to seek in. Records
    are written by classes of size, so that a file has at most 1,000 records
    and about 128 MiB before compression, and long records change the number
    of files of no other class."""
    sized = pages.withColumn("_class", size_class(pages)).select("page_id", "url", "html", "_class")
    classes = sorted(r[0] for r in sized.select("_class").distinct().collect()) or [0]  # a number for each doubling of the length
    records = with_revisits(sized, least_bytes=least_bytes)
    for k, c in enumerate(classes):
        rows = record_text(records.where(F.col("_class") == c))
        rows.write.mode("append" if k else "errorifexists").option("lineSep", END).option("maxRecordsPerFile", max(1, RECORDS_PER_FILE >> c)).option("compression", compression).text(path)


def header_fields(head: bytes) -> dict[str, str]:
    return {m[1].lower().decode("latin-1"): m[2].strip().decode("utf-8", "replace") for m in FIELD.finditer(head)}


def whole_number(value: str | None) -> int | None:
    """A count of bytes; None for anything else than up to 18 digits."""
    return int(value) if value and NUMBER.fullmatch(value) else None


def page_of(name: str) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?[0-9]{1,19})>", name)
    return int(m[1]) if m and -(1 << 63) <= int(m[1]) < 1 << 63 else None


CANDIDATE = "file string, off long, next long, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, digest_ok boolean"


def scan(content: bytes) -> Iterator[tuple]:
    """Every place that reads like a record: offset, successor, and fields. A
    header runs to the first blank line, however far that is. A candidate that
    overruns the file has no successor and no record, nor has one with a second
    magic line in its header or with fields that do not read as they should."""
    places = [m.start() for m in MAGIC.finditer(content)]
    end = -1
    for place, after in zip(places, [*places[1:], len(content)]):
        # The blank line found for one candidate is that of all before it.
        if end < place:
            end = content.find(b"\r\n\r\n", place)
        if end < 0:
            return
        if end > after:
            continue
        fields = header_fields(content[place:end])
        length = whole_number(fields.get("content-length"))
        if length is None:
            continue
        start = end + 4
        stop = start + length
        if content[stop : stop + 4] != b"\r\n\r\n":
            continue
        kind = fields.get("warc-type", "")
        claimed = fields.get("warc-payload-digest", "").removeprefix("sha1:")
        size = whole_number(fields.get("x-payload-length")) or 0
        digest, good = claimed, None
        if kind == "response":
            body = content.find(b"\r\n\r\n", start, stop)
            body = stop if body < 0 else body + 4
            size = stop - body
            digest = base64.b32encode(hashlib.sha1(memoryview(content)[body:stop]).digest()).decode()
            good = digest == claimed
        yield (
            place, stop + 4, page_of(fields.get("warc-record-id", "")), fields.get("warc-target-uri"), size, digest, kind,
            page_of(fields.get("warc-refers-to", "")), good,
        )


def candidates(spark: SparkSession, path: str) -> DataFrame:
    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"]):
                rows = list(scan(gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content))
                if rows:
                    out = pd.DataFrame(rows, columns=[x.split()[0] for x in CANDIDATE.split(", ")][1:])
                    out.insert(0, "file", file)
                    yield out.astype({"page_id": "Int64", "refers_to": "Int64", "digest_ok": "boolean"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(emit, CANDIDATE)


def on_chain(off: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Which candidates the chain from offset 0 reaches. off is sorted and
    distinct. Pointers are doubled until they all rest: a chain of n records
    takes log2(n) rounds."""
    n = len(off)
    at = np.searchsorted(off, follows)
    jump = np.append(np.where(off[np.minimum(at, n - 1)] == follows, at, n), n)  # n is the end
    jump[jump > n] = n
    on = np.zeros(n + 1, bool)
    on[0] = n > 0 and off[0] == 0
    while True:
        on[jump[on]] = True
        far = jump[jump]
        if (far == jump).all():
            return on[:n]
        jump = far


def keep_reached(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("off", kind="stable")
    return pdf[on_chain(pdf["off"].to_numpy(), pdf["next"].to_numpy())]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and
    digest_ok (null for revisits) of the records of all archives at ``path``.

    A broken record ends its file: what the chain does not reach is no record.
    An archive is one binary value, so Spark's limit of 2 GB a file holds.
    """
    # A group is what one archive holds, which the size of a file bounds.
    chains = candidates(spark, path).groupBy("file").applyInPandas(keep_reached, CANDIDATE)
    return chains.drop("file", "off", "next")


def round_trip(pages: DataFrame, *, least_bytes: int = 0) -> DataFrame:
    """Writes archives of ``pages`` to the shared folder and reads them back."""
    spark = pages.sparkSession
    path = new_folder(spark, "warc")
    write_archives(pages, path, least_bytes=least_bytes)
    return read_archives(spark, path)


SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages
), d AS (
  SELECT page_id, strlen(h) AS payload_bytes,
    array_to_string(list_transform(range(8), lambda i: (
      WITH_FIVE
    )), '') AS payload_digest
  FROM p
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
""".replace(
    "WITH_FIVE",
    " || ".join(f"substr('{ALPHABET}', CAST(((('0x' || substr(x, CAST(i * 5 + 1 AS INT), 5))::INT >> {s}) & 31) + 1 AS INT), 1)" for s in (15, 10, 5, 0)),
)
