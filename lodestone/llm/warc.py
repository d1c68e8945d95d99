r"""WARC archives with revisit records.

Headers (page, digest, length) are shuffled by payload digest without their payloads; of equal payloads
of at least `least_bytes` the one with the smallest page_id stays a response and the others become revisit
records that refer to it. Archives are written with fresh headers through Spark's own file writer, which
only publishes the files of tasks that committed and works on any store, and are read back by their
Content-Length. An archive is read as one row, so its payloads are bounded: FILES sets how many records of a size go into
one file, and the largest have a file each.

Payloads are equal if their SHA-256 and length are; the header shows SHA-1 in base32, as archives do.

Defined results: a null payload is empty, and equal to other empty ones; a null page_id loses against any
other; a row that repeats the response's page_id and payload is a response too; a null url is
written as an empty target; an empty table gives no archives and no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, key_bitmap, scratch, stored, with_hit

END = "\r\n\r\n"
#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records in a file by the bytes of their payloads: 256 MB at most, but for a single larger record.
FILES = ((1 << 18, 1000), (1 << 24, 16), (1 << 31, 1))
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hexa: Column) -> Column:
    """A SHA-1 in hex (40 digits) as 32 letters: each 5 digits are 4 letters."""
    parts = []
    for i in range(0, 40, 5):
        n = F.conv(F.substring(hexa, i + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(BASE32), F.shiftright(n, 15 - 5 * k).bitwiseAND(31) + 1, F.lit(1)) for k in range(4)]
    return F.concat(*parts)


def record_id(page: Column, sha: Column) -> Column:
    """A name-based UUID of page and payload, the same in every attempt of a task."""
    h = F.sha2(F.concat_ws("/", F.lit("page"), page.cast("string"), sha), 256)
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-a"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def resolve(headers: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Of headers (page_id, url, sha, payload_bytes): sha, rows, payload_bytes, and the page first, by digest of at least `least_bytes`.

    The aggregate combines before the shuffle, so a digest of very many pages is no burden.
    """
    order = F.struct(F.col("page_id").isNull(), "page_id")
    return headers.where(F.col("payload_bytes") >= least_bytes).groupBy("sha").agg(F.count(F.lit(1)).alias("rows"), F.max("payload_bytes").alias("payload_bytes"), F.min_by(F.struct("page_id", "url"), order).alias("first"))


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", files: tuple[tuple[int, int], ...] = FILES) -> None:
    """Write one record a row of page_id, url, html below `path`.

    Only headers are shuffled by digest. Payloads move where their digest may have several pages and they may be the
    response, and then by digest and page. Pages beyond the first size in `files` are written in a pass of their own, where
    there are any: a folder for each size.
    """
    src = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    src = src.withColumns({"sha1": F.sha1("payload"), "sha": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long")})
    firsts = stored(resolve(src.drop("payload", "sha1"), least_bytes), "warc-digests")
    bitmap = key_bitmap(firsts.where("rows > 1"), "sha", "warc-hits")
    marked = with_hit(src, bitmap, "sha").withColumn("hit", F.col("hit") & (F.col("payload_bytes") >= least_bytes))
    first = firsts.select("sha", "first")
    own = F.col("page_id").eqNullSafe(F.col("first.page_id"))
    none = F.lit(None).cast(first.schema["first"].dataType)
    alone = marked.where("NOT hit").withColumn("first", none)
    lead = firsts.select(F.col("sha").alias("lead_sha"), F.col("first.page_id").alias("lead_page"))
    hits = marked.where("hit")
    leads = hits.join(lead, (F.col("sha") == F.col("lead_sha")) & F.col("page_id").eqNullSafe(F.col("lead_page")), "left_semi").withColumn("first", none)
    others = hits.withColumn("payload", F.lit("")).join(first, "sha").where(~own)
    rows = alone.unionByName(leads).unionByName(others).withColumn("revisit", F.col("first").isNotNull())

    def line(key: str, value: Column) -> Column:
        return F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))

    def tidy(url: Column) -> Column:
        return F.regexp_replace(F.coalesce(url, F.lit("")), "[\\x00-\\x1F]", "")

    about = [line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", record_id(F.col("first.page_id"), F.col("sha"))), line("WARC-Refers-To-Target-URI", tidy(F.col("first.url"))), line("WARC-Refers-To-Date", F.lit(date))]
    head = F.concat(
        F.lit(f"{VERSION}\r\n"),
        line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", record_id(F.col("page_id"), F.col("sha"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", tidy(F.col("url"))),
        F.when(F.col("page_id").isNotNull(), line("X-Page-ID", F.col("page_id").cast("string"))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1")))),
        F.when(F.col("revisit"), F.concat(*about)).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.octet_length("payload").cast("string")),
        F.lit("\r\n"),
    )
    bound = firsts.agg(F.max("payload_bytes")).first()[0] or 0
    written = F.octet_length("payload")
    least = -1
    for i, (most, count) in enumerate(files):
        last = i + 1 == len(files)
        if least < max(bound, least_bytes):
            some = rows.where((written > least) if last else (written > least) & (written <= most))
            some.select(F.concat(head, F.col("payload")).alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", count).text(f"{path}/size-{i}")
        least = most
    discard(firsts, bitmap.words)


def records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and payload of each record of an archive, by its Content-Length."""
    at = 0
    while at < len(content):
        stop = content.index(b"\r\n\r\n", at)
        lines = content[at:stop].decode().split("\r\n")
        if not re.fullmatch(r"WARC/\d\.\d", lines[0]):
            raise ValueError(f"no record at byte {at}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(head["content-length"])
        if content[stop + 4 + size : stop + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end where it says")
        yield head, content[stop + 4 : stop + 4 + size]
        at = stop + 8 + size


FIELDS = "record_id string, record_type string, url string, page_id string, payload_digest string, refers_to_id string, payload_bytes long, payload binary"


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives below `path`; digests of responses are checked against their payloads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in FIELDS.split(", ")]
        kinds = [pa.string()] * 6 + [pa.int64(), pa.binary()]

        def batch_of(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for i in range(len(batch)):
                rows, held = [], 0
                for head, payload in records(batch["content"][i].as_py()):
                    kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"{head['warc-record-id']}: the payload does not have its digest")
                    rows.append((head["warc-record-id"], kind, head.get("warc-target-uri"), head.get("x-page-id"), digest, head.get("warc-refers-to"), len(payload) if kind == "response" else None, payload if payloads else None))
                    held += len(payload) if payloads else 100
                    if held > 4 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(path).select("content").mapInArrow(run, FIELDS)


def followed(got: DataFrame) -> DataFrame:
    """Records with the page and length of the response that each revisit refers to: a join of headers only."""
    got = got.drop("payload")
    target = got.where("record_type = 'response'").dropDuplicates(["record_id"]).select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("target_bytes"))
    seen = got.where("record_type = 'revisit'").join(target, "refers_to_id").withColumn("payload_bytes", F.col("target_bytes")).drop("target_bytes")
    alone = got.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("string"))
    return alone.unionByName(seen)


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each page, from archives written and read back."""
    path = scratch(pages.sparkSession, "warc")
    write_archives(pages, path)
    got = stored(read_archives(pages.sparkSession, path, payloads=False), "warc-records")
    discard(path)
    kind = pages.schema["page_id"].dataType
    return followed(got).select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
