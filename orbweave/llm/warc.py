"""Content-addressed WARC archive.

An archive is two tables.  ``payloads`` holds each payload once, under its
SHA-256; ``records`` holds the exact header blocks of every record and the
digest of its payload.  Original records come back by joining the two, and
every payload is hashed again on the way out, so a damaged store raises
instead of returning other bytes.

Of records with equal payloads of at least ``min_revisit`` bytes, the one with
the smallest id is a ``response`` and the others are ``revisit`` records.

Defined results: a null payload is empty; of repeated rows with one id and
one payload, the first by URL counts as the smallest; records with a null id
come after those with one, and ``refers_to`` is null if no record of the group
has an id.  Columns besides id, URL and payload are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbweave.llm.common import Workspace, table

CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))


def _uri(record_id: Column, n: Column) -> Column:
    """<urn:record:ID>, with the copy number behind a dot for repeated ids."""
    known = F.coalesce(record_id.cast("string"), F.lit("none"))
    return F.concat(F.lit("<urn:record:"), known, F.when(n > 1, F.concat(F.lit("."), n.cast("string"))).otherwise(F.lit("")), F.lit(">"))


def write_archive(records: DataFrame, ws: Workspace, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = 100) -> "Archive":
    """Store ``records`` (a string or binary payload each) in ``ws``.

    The payload is shuffled once, by its record's id, which is unique; the
    digest, which a third of all rows may share, only ever keys small rows.
    """
    payload = F.coalesce(F.encode(F.col(payload_col), "UTF-8") if dict(records.dtypes)[payload_col] == "string" else F.col(payload_col), F.lit(b""))
    rows = records.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))

    light = rows.select("id", "url", "digest", F.octet_length("payload").cast("long").alias("length"))
    light = light.withColumn("copy", F.row_number().over(Window.partitionBy("id", "digest").orderBy("url")))
    light = ws.save(light, "light")
    firsts = ws.save(light.groupBy("digest").agg(F.min("id").alias("first_id")), "firsts")

    # A key without nulls: the join and the removal of repeated rows then share one exchange.
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none")).alias("key")
    stored = rows.select(key("id"), "digest", "payload").join(firsts.select(key("first_id"), "digest"), ["key", "digest"], "left_semi")
    ws.save(stored.dropDuplicates(["key", "digest"]).select("digest", "payload"), "payloads")

    first = (F.col("copy") == 1) & F.col("id").eqNullSafe(F.col("first_id"))
    kind = F.when(first | (F.col("length") < min_revisit), "response").otherwise("revisit")
    headed = light.join(firsts, "digest").withColumn("kind", kind)
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("length").cast("string"), F.lit(CRLF * 2))
    block = F.octet_length("http") + F.when(F.col("kind") == "response", F.col("length")).otherwise(0)
    revisit = F.when(
        F.col("kind") == "revisit",
        F.concat(
            F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}"),
            F.when(F.col("first_id").isNotNull(), _line("WARC-Refers-To", _uri(F.col("first_id"), F.lit(1)))).otherwise(F.lit("")),
        ),
    ).otherwise(F.lit(""))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", F.col("kind")),
        _line("WARC-Record-ID", _uri(F.col("id"), F.col("copy"))),
        _line("WARC-Date", F.lit(DATE)),
        F.when(F.col("url").isNotNull(), _line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", ""))).otherwise(F.lit("")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        revisit,
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}"),
        _line("Content-Length", block.cast("string")),
        F.lit(CRLF),
    )
    headed = headed.withColumn("http", http).select("id", "copy", header.alias("header"), "http", "digest")
    ws.save(headed, "records")
    ws.drop("light", "firsts")
    return Archive(ws)


class Archive:
    """An archive on disk, read through joins."""

    def __init__(self, ws: Workspace):
        self.ws = ws

    def headers(self) -> DataFrame:
        """Each record's fields, parsed from its header block, whose lines end at CRLF alone: a URL may hold other separators."""
        field = lambda name: F.regexp_extract("header", rf"(?md)^{name}: ([^\r]*)", 1)
        refers = F.regexp_extract("header", r"(?md)^WARC-Refers-To: <urn:record:([^.>]*)", 1)
        return self.ws.load("records").select("id", "copy", "header", "http", "digest", field("WARC-Type").alias("record_type"), F.nullif(refers, F.lit("")).alias("refers_to"), field("WARC-Target-URI").alias("url"))

    def payloads(self) -> DataFrame:
        """Each stored payload once, hashed again against its address."""
        good = F.sha2("payload", 256) == F.col("digest")
        checked = F.when(good, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload does not match its digest "), F.col("digest"))).cast("binary"))
        return self.ws.load("payloads").select("digest", checked.alias("payload"))

    def index(self) -> DataFrame:
        """A row per record with the verified length of its payload; no payload is shuffled."""
        facts = self.payloads().select("digest", F.octet_length("payload").cast("long").alias("payload_bytes"))
        return self.headers().join(facts, "digest")

    def originals(self) -> DataFrame:
        """The original records: headers and the full payload, revisits included."""
        return self.headers().join(self.payloads(), "digest").select("id", "copy", "record_type", "refers_to", "url", F.concat(F.encode(F.concat("header", "http"), "UTF-8"), F.col("payload")).alias("record"), "payload")

    def export(self, path: str) -> None:
        """Write standard WARC files: a revisit's block ends with its HTTP header.

        For payloads that are UTF-8 text.  Spark's text writer puts the last
        CRLF of each record.
        """
        body = F.when(F.col("record_type") == "response", F.decode("payload", "UTF-8")).otherwise(F.lit(""))
        responses = self.headers().join(self.payloads(), "digest")
        responses.select(F.concat("header", "http", body, F.lit(CRLF)).alias("value")).write.option("lineSep", CRLF).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of uncompressed WARC files: header block and content block of each.

    Each file is one row of Spark's binary reader, so files should be of a
    common size, 1 GB at most.
    """

    def parse(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            heads, blocks = [], []
            for content in batch.column(0).to_pylist():
                at = 0
                while at < len(content):
                    end = content.index(b"\r\n\r\n", at) + 4
                    size = next(int(x.split(b":")[1]) for x in content[at:end].split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    heads.append(content[at:end].decode("utf-8", "replace"))
                    blocks.append(content[end : end + size])
                    at = end + size + 4
            yield pa.RecordBatch.from_arrays([pa.array(heads, pa.string()), pa.array(blocks, pa.binary())], ["header", "block"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, "header string, block binary")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record is rebuilt from its headers and its stored payload; length and digest are those of the rebuilt payload."""
    archive = write_archive(table(spark, sf_dir, "pages"), Workspace(spark, "warc"))
    out = archive.originals()
    length, digest = F.octet_length("payload").cast("long"), F.sha2("payload", 256)
    return out.select(F.col("id").alias("page_id"), length.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", F.col("refers_to").cast("long").alias("refers_to"))


ORACLE = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), q AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes < 100 OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN payload_bytes < 100 OR page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM q
"""
