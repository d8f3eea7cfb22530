"""Embeddings as JSON lines, points as ``LAT LNG`` lines, and the sinks for markers.

Readers are batch or streaming (``stream=True``).  A line is a JSON array of
numbers, or an object with ``embedding`` and optionally ``id``; other fields and
blank lines are ignored.  ``error`` names what is wrong with a line, and
``strict`` raises it instead.

``numbered`` readers add ``file`` and ``line``, and errors name both.  Spark cuts
files into splits that don't know how many lines precede them, so lines are
counted per split first, and each split's count is moved up by those before it
in its file: two passes, and no file is gathered anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbweave import errors
from orbweave.functions import lsh
from orbweave.functions.unsigned import hex16

MAX_LINE = 4 << 20


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line, value)`` of text files; lines count from 1 in each file."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    splits = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("file", "block", (before - F.col("first") + 1).alias("shift"))  # a row per split of the input
    return lines.join(splits, ["file", "block"]).select("file", (F.col("at") + F.col("shift")).alias("line"), "value")


def _lines(spark: SparkSession, path: str, stream: bool, numbered: bool) -> DataFrame:
    if numbered and stream:
        raise ValueError("lines of a stream have no numbers")
    return numbered_lines(spark, path) if numbered else (spark.readStream if stream else spark.read).text(path)


def _place(lines: DataFrame) -> list[str]:
    return ["file", "line"] if "line" in lines.columns else []


def _named(lines: DataFrame, error: Column) -> Column:
    """The error with file and line, where they are known."""
    return F.concat(F.col("file"), F.lit(", line "), F.col("line").cast("string"), F.lit(": "), error) if _place(lines) else error


def read_embeddings(spark: SparkSession, path: str, *, width: int | None = None, max_line: int = MAX_LINE, stream: bool = False, strict: bool = False, numbered: bool = False) -> DataFrame:
    """``(id, id_json, kind, embedding, error)``: ``id`` as plain text, ``id_json`` as it stood in the line."""
    return parse_embeddings(_lines(spark, path, stream, numbered), width=width, max_line=max_line, strict=strict)


def parse_embeddings(lines: DataFrame, *, width: int | None = None, max_line: int = MAX_LINE, strict: bool = False) -> DataFrame:
    at = _place(lines)
    text = F.trim(F.regexp_replace("value", r"^[ \t\r]+|[ \t\r]+$", ""))
    rows = lines.select(*at, text.alias("text"), F.octet_length("value").alias("bytes")).where("text <> ''")
    whole = F.col("text").startswith("[")
    numbers = F.when(whole, F.col("text")).otherwise(F.get_json_object("text", "$.embedding"))
    plain = numbers.rlike(r"\A\s*\[[-+0-9.eE,\s]*\]\s*\z")
    embedding = F.when(plain, F.from_json(numbers, "array<float>"))
    own = F.try_parse_json("text")
    kind = F.when(~whole, F.schema_of_variant(F.try_variant_get(own, "$.id", "variant")))
    id_json = F.when(~whole, F.to_json(F.try_variant_get(own, "$.id", "variant")))
    rows = rows.select(*at, F.when(~whole, F.get_json_object("text", "$.id")).alias("id"), id_json.alias("id_json"), kind.alias("kind"), embedding.alias("embedding"), "bytes")
    bad = (
        F.when(F.col("bytes") > max_line, F.concat(F.lit(f"line over the limit of {max_line} bytes: "), F.col("bytes").cast("string")))
        .when(F.col("embedding").isNull(), F.lit("no array of numbers found"))
        .when(F.size("embedding") == 0, F.lit("the array holds no number"))
        .when(F.lit(width is not None) & (F.size("embedding") != (width or 0)), F.concat(F.size("embedding").cast("string"), F.lit(f" numbers where {width} are due")))
        .when(F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(errors.NonFiniteValue.__name__))
        .when(F.forall("embedding", lambda v: v == 0), F.lit(errors.ZeroVector.__name__))
    )
    rows = rows.select(*at, "id", "id_json", "kind", "embedding", _named(lines, bad).alias("error"))
    if strict:
        rows = rows.where(F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).cast("boolean")).otherwise(F.lit(True)))
    return rows


def text_ids(df: DataFrame) -> Column:
    """An id for text output: a string or whole number without tab or line break, else an error."""
    bad = F.col("kind").isNotNull() & ~F.col("kind").rlike("STRING|BIGINT|VOID")
    broken = F.col("id").rlike("[\t\r\n]")
    return F.when(bad, F.raise_error(F.lit("only texts and numbers serve as ids"))).when(broken, F.raise_error(F.lit("an id with a tab or line end breaks its line"))).otherwise(F.col("id"))


def marker_lines(df: DataFrame, marker: Column | str = "marker") -> DataFrame:
    """``value`` lines ``ID<TAB>MARKER`` or ``MARKER``, for ``write.text``."""
    return df.select(F.concat_ws("\t", text_ids(df), marker).alias("value"))


def json_lines(df: DataFrame, *fields: str) -> DataFrame:
    """``value`` lines of JSON objects with ``id`` first, left out where there is none."""
    own = F.try_parse_json("id_json").alias("id")
    return df.select(F.to_json(F.struct(own, *fields)).alias("value"))


def _point() -> tuple[Column, Column, Column, Column]:
    """Of a ``value``: latitude, longitude, whether it is blank, and what is wrong with it."""
    plain = F.trim(F.regexp_replace("value", r"[ \t\r]+", " "))
    part = F.split(plain, " ")
    lat, lng = (F.try_element_at(part, F.lit(i)).try_cast("double") for i in (1, 2))
    bad = F.when(F.octet_length("value") > 512, F.lit("over 512 bytes")).when((F.size(part) != 2) | lat.isNull() | lng.isNull(), F.lit("not two numbers"))
    return lat, lng, plain == "", bad


def read_points(spark: SparkSession, path: str, *, stream: bool = False, numbered: bool = False) -> DataFrame:
    """``(lat, lng, error)`` of ``LAT LNG`` lines; exactly two numbers a line, 512 bytes at most."""
    lines = _lines(spark, path, stream, numbered)
    lat, lng, blank, bad = _point()
    return lines.where(~blank).select(*_place(lines), lat.alias("lat"), lng.alias("lng"), _named(lines, bad).alias("error"))


def read_regions(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """``(region_id, kind, points, radius_m)`` for ``covers.cover_regions``: each file of ``LAT LNG`` lines is one polyline or polygon, its points in line order.

    A file without a point or with a wrong line stops the job with the file and the line's number.
    """
    lat, lng, blank, bad = _point()
    rows = numbered_lines(spark, path).select("file", "line", blank.alias("blank"), bad.alias("bad"), lat.alias("lat"), lng.alias("lng"))
    point = F.when(~F.col("blank"), F.struct("line", "lat", "lng"))
    wrong = F.when(~F.col("blank") & F.col("bad").isNotNull(), F.struct("line", "bad"))
    found = rows.groupBy(F.col("file").alias("region_id")).agg(F.array_sort(F.collect_list(point)).alias("points"), F.min(wrong).alias("wrong"))
    stop = lambda *words: F.raise_error(F.concat(F.col("region_id"), *words))
    points = F.transform("points", lambda p: F.struct(p["lat"].alias("lat"), p["lng"].alias("lng")))
    line = F.col("wrong")["line"].cast("string")
    good = F.when(line.isNotNull(), stop(F.lit(", line "), line, F.lit(": "), F.col("wrong")["bad"])).when(F.size("points") == 0, stop(F.lit(" holds no point"))).otherwise(points)
    return found.select("region_id", F.lit(kind).alias("kind"), good.alias("points"), F.lit(None).cast("double").alias("radius_m"))


def hash_lines(df: DataFrame, *, n_probes: int = 0, space: lsh.Tables = lsh.Tables()) -> DataFrame:
    """``value`` lines of JSON objects with ``id``, ``marker``, ``keys`` and, if ``n_probes`` asks for them, ``probes`` per table, as hex; of ``df (id_json, embedding)``."""
    texts = lambda keys: F.transform(keys, lambda k: F.substr(hex16(k), F.lit(17 - space.digits), F.lit(space.digits)))
    rows = df.select("id_json", "embedding", lsh.keys("embedding", space).alias("own"))
    fields = [lsh.marker("own", space).alias("marker"), texts(F.col("own")).alias("keys")]
    if n_probes:
        fields.append(F.transform(lsh.probes("embedding", n_probes, space), texts).alias("probes"))
    return json_lines(rows.select("id_json", *fields), *[f for f in ("marker", "keys", "probes")[: 2 + bool(n_probes)]])


def range_lines(ranges: DataFrame) -> DataFrame:
    """``value`` lines ``LO HI`` in unsigned decimal, of ``ranges (lo, hi)``."""
    from orbweave.functions.unsigned import unsigned_decimal

    return ranges.select(F.concat_ws(" ", unsigned_decimal("lo").cast("string"), unsigned_decimal("hi").cast("string")).alias("value"))
