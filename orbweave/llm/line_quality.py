"""Quality rules with cross-document line frequency.

Lines are normalised (lower case, digits to 0, runs of other characters to one
space) and hashed.  For each host (``documents.source``) the number of distinct
texts that hold a line is counted; a line in more than ``max(min_docs,
max_share * texts of the host)`` of them is boilerplate and is removed.  A
document whose lines are removed until fewer than ``min_words`` words or less
than ``min_left`` of its words remain is depleted and rejected, as is one that
fails the base rules.

Exact copies count as one text, so copies alone never make a line frequent.

Defined results: null text is empty and fails the base rules; a null host is
a host of its own; lines without letters or digits are never frequent;
repeated rows get equal results.  Other columns pass through ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm.common import Workspace, fresh, table, text_or_empty

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows that occur twice or more, the first occurrence included.

    Windows get exact ranks by doubling: equal pairs of equal halves.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    rank = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(ids) == len(words):
        return 0
    size = 1
    while size < window:
        pairs = rank[:-size] * (int(rank.max()) + 1) + rank[size:]
        rank = np.unique(pairs, return_inverse=True)[1]
        size *= 2
    hit = np.bincount(rank)[rank] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(hit)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def text_counts(text: str) -> tuple[int, int, int, int, int]:
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # bytes split at ASCII white space only
    chars = len(text) - sum(text.count(c) for c in SPACES)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = data.split(b"\n")
    duplicates = 0
    if len(lines) > 1:
        seen: set[bytes] = set()
        for line in lines:
            if line in seen:
                duplicates += 1
            elif line and not line.isspace():
                seen.add(line)
    return len(words), chars, symbols, duplicates, repeated_words(words)


def _measure(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        counts = [text_counts(x) for x in batch.column("text").to_pylist()]
        columns = list(zip(*counts)) if counts else [[]] * 5
        arrays = [batch.column(i) for i in range(batch.num_columns)] + [pa.array(c, pa.int64()) for c in columns]
        names = batch.schema.names + [x.split()[0] for x in COUNTS.split(", ")]
        keep = [i for i, x in enumerate(names) if x != "text"]
        yield pa.RecordBatch.from_arrays([arrays[i] for i in keep], [names[i] for i in keep])


def normalised(line):
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"\p{N}", "0"), r"[^\p{L}\p{N}]+", " "))


def line_hashes(text):
    """One hash per line; null where the line has no letter or digit."""
    return F.transform(F.split(text, "\n"), lambda x: F.when(x.rlike(r"[\p{L}\p{N}]"), F.xxhash64(normalised(x))))


def measure(docs: DataFrame, ws: Workspace, *, min_docs: int = 10, max_share: float = 0.05, min_left: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Verdicts: a row per document; and the frequent lines of each (host, text).

    Documents are read once.  What is shuffled is a hash per line; counts are
    summed before and after each exchange, so no line or host is hot.
    """
    text = text_or_empty()
    rows = docs.select(
        "doc_id",
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"),
        F.xxhash64(text).alias("text_hash"),
        text.alias("text"),
        line_hashes(text).alias("lines"),
        F.transform(F.split(text, "\n"), lambda x: F.size(F.filter(F.split(x, r"[\x20\x09-\x0D]+"), lambda w: w != ""))).alias("line_words"),
    )
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, host string, text_hash long, lines array<long>, line_words array<int>, {COUNTS}"
    rows = ws.save(rows.mapInArrow(_measure, schema), "measured")

    line = rows.select("host", "text_hash", F.explode(F.arrays_zip(F.col("lines").alias("lines"), F.sequence(F.lit(0), F.size("lines") - 1).alias("at"), F.col("line_words").alias("line_words"))).alias("x"))
    line = line.select("host", "text_hash", F.col("x.lines").alias("line"), F.col("x.at").alias("at"), F.col("x.line_words").alias("words")).where("line is not null")
    texts = line.select("host", "text_hash", "line").distinct().groupBy("host", "line").agg(F.count("*").alias("texts"))
    hosts = rows.select("host", "text_hash").distinct().groupBy("host").agg(F.count("*").alias("host_texts"))
    often = texts.where(F.col("texts") > min_docs).join(hosts, "host").where(F.col("texts") > F.greatest(F.lit(float(min_docs)), F.col("host_texts") * max_share)).select("host", "line")
    often = ws.save(often, "often")

    hits = ws.save(line.join(often, ["host", "line"]).select("host", "text_hash", "at", "words"), "hits")
    lost = hits.distinct().groupBy("host", "text_hash").agg(F.sum("words").alias("boilerplate_words"), F.array_sort(F.collect_list("at")).alias("boilerplate_lines"))
    lost = ws.save(lost, "lost")

    verdict = rows.drop("lines", "line_words").join(lost, ["host", "text_hash"], "left")
    gone = F.coalesce("boilerplate_words", F.lit(0))
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    left = F.col("n_words") - gone
    depleted = (gone > 0) & ((left < MIN_WORDS) | (left < min_left * F.col("n_words")))
    verdict = verdict.select(*rows.drop("lines", "line_words").columns, gone.cast("long").alias("boilerplate_words"), base_failed.alias("base_failed"), (~base_failed & ~depleted).alias("kept"))
    return verdict, lost


def clean(docs: DataFrame, ws: Workspace, **limits) -> DataFrame:
    """Documents that pass, without their boilerplate lines; columns as before."""
    verdict, lost = measure(docs, ws, **limits)
    good = ws.save(verdict.where("kept").select("host", "text_hash").distinct(), "good")
    host, key, lines = fresh(docs, "host"), fresh(docs, "text_hash"), fresh(docs, "boilerplate_lines")
    keyed = docs.withColumn(host, F.coalesce(F.col("source").cast("string"), F.lit(""))).withColumn(key, F.xxhash64(text_or_empty()))
    good = good.join(lost.select("host", "text_hash", "boilerplate_lines"), ["host", "text_hash"], "left")
    good = ws.save(good.select(F.col("host").alias(host), F.col("text_hash").alias(key), F.col("boilerplate_lines").alias(lines)), "verdicts")
    left = F.array_join(F.filter(F.split(F.col("text"), "\n"), lambda _, i: ~F.array_contains(lines, i)), "\n")
    text = F.when(F.col(lines).isNull(), F.col("text")).otherwise(left)
    return keyed.join(good, [host, key]).withColumn("text", text).select(*docs.columns)


def op7_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict, _ = measure(table(spark, sf_dir, "documents"), Workspace(spark, "quality"))
    return verdict.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "boilerplate_words")


#: The same in SQL; normalised lines stand for themselves instead of their hashes.
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents
), words AS (
  SELECT r, unnest(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS w, unnest(range(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')))) AS p FROM d
), windows AS (
  SELECT r, p, w, CASE WHEN lead(w, 7) OVER o IS NOT NULL THEN [w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o, lead(w, 5) OVER o, lead(w, 6) OVER o, lead(w, 7) OVER o] END AS v
  FROM words WINDOW o AS (PARTITION BY r ORDER BY p)
), twice AS (
  SELECT r, p, w, v IS NOT NULL AND count(*) OVER (PARTITION BY r, v) > 1 AS hit FROM windows
), counted AS (
  SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars, sum(near::INT) AS n_repeat_words FROM (
    SELECT r, w, max(hit) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS near FROM twice) GROUP BY r
), lines AS (
  SELECT r, host, t, x, nth, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n,
    CASE WHEN regexp_matches(x, '[\pL\pN]') THEN trim(regexp_replace(regexp_replace(lower(x), '\pN', '0', 'g'), '[^\pL\pN]+', ' ', 'g'), ' ') END AS line
  FROM (SELECT r, host, t, unnest(string_split(t, chr(10))) AS x, unnest(range(len(string_split(t, chr(10))))) AS nth FROM d)
), again AS (
  SELECT r, sum((k > 1 AND n > 0)::INT) AS n_dup_lines FROM (SELECT r, n, row_number() OVER (PARTITION BY r, x ORDER BY nth) AS k FROM lines) GROUP BY r
), often AS (
  SELECT host, line FROM (SELECT host, line, count(DISTINCT t) AS texts FROM lines WHERE line IS NOT NULL GROUP BY host, line)
  JOIN (SELECT host, count(DISTINCT t) AS host_texts FROM d GROUP BY host) USING (host) WHERE texts > greatest(10, host_texts * 0.05)
), lost AS (
  SELECT r, sum(n) AS gone FROM lines SEMI JOIN often USING (host, line) GROUP BY r
), facts AS (
  SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    n_dup_lines::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(gone, 0)::BIGINT AS boilerplate_words
  FROM d JOIN again USING (r) LEFT JOIN counted USING (r) LEFT JOIN lost USING (r)
), judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    boilerplate_words > 0 AND (n_words - boilerplate_words < 20 OR n_words - boilerplate_words < 0.5 * n_words) AS depleted FROM facts
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT depleted AS kept, boilerplate_words FROM judged
"""
