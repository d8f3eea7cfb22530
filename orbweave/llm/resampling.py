"""Target-distribution importance resampling with hashed n-grams of words.

Features are the runs of 1 to n consecutive words; each falls into the bucket
given by its CRC.  A bucket's gain is the scaled logarithm of how much commoner
it is in the target texts than in the corpus, both smoothed; a document's weight
is the floored mean of its features' gains, and its score adds Gumbel noise
derived from its id, so that taking the highest scores draws without
replacement in proportion to the weights' exponentials.

Texts are cut into overlapping chunks at word boundaries: a chunk owns the
features that start at its ``CHUNK_WORDS`` words and carries the next n-1 words,
so each feature is counted once, in one chunk.  A text of up to ``DEALT_BYTES``
is cut and summed where it is read; the chunks of longer ones are dealt to
all tasks, and their counts and gains are summed by document, so that the work
of a skewed text is shared out.

Only the bucket table is ever broadcast or collected: ``buckets`` rows.  Ranks come
from a histogram of the scores, which takes few values at any size of the
corpus: gains are logarithms of counts, noise comes from 32 bits, so about
100,000 in all; ties within a score are ordered in a window of that score's
drawn documents alone.

Defined results: null and empty texts have no words: no features, weight 0,
never drawn; a null id is hashed as the empty string and comes last among ties;
repeated rows are documents of their own, each with a rank; an empty corpus gives
no rows, an empty target gains from smoothing alone.  Columns other than id and
text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbweave.llm.common import Workspace, shuffle_parts, table

CHUNK_WORDS, DEALT_BYTES, BATCH_BYTES, LONG_WORD = 2048, 32768, 1 << 20, 64

#: ASCII capitals become small letters, other ASCII but digits and letters becomes a space; words are what lies between spaces.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)  # fixed value: the reflected polynomial of CRC-32
    return t


_CRC = _crc_table()
_ALL = np.uint32(0xFFFFFFFF)


@dataclass(frozen=True)
class Features:
    """Runs of 1 to ``n`` words, in ``buckets`` buckets."""

    n: int = 2
    buckets: int = 10000


def cut(text: str | None, n: int, size: int | None = None) -> Iterator[tuple[bytes, int]]:
    """Chunks of a text, each with the number of words that it owns; a text without words has none."""
    size = size or CHUNK_WORDS
    data = (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN)
    starts, ends = _spans(np.frombuffer(data, np.uint8))
    for at in range(0, len(starts), size):
        own = min(size, len(starts) - at)
        yield data[starts[at] : ends[min(at + own + n - 2, len(ends) - 1)]], own


def _spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = data != 32
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _crc_on(state: np.ndarray, data: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC registers ``state`` after the bytes of each stretch; all stretches advance together, longest first."""
    import zlib

    size = ends - starts
    long = np.flatnonzero(size > LONG_WORD)
    order = np.argsort(-size, kind="stable")[len(long) :]
    c, at = state[order], starts[order]
    left = len(order)
    counts = np.bincount(size[order], minlength=2)
    for k in range(int(size[order[0]]) if left else 0):
        left -= int(counts[k])
        c[:left] = _CRC[(c[:left] ^ data[at[:left] + k]) & 255] ^ (c[:left] >> 8)
    out = np.empty(len(state), np.uint32)
    out[order] = c
    for i in long:
        out[i] = zlib.crc32(raw[starts[i] : ends[i]], int(state[i] ^ _ALL)) ^ 0xFFFFFFFF
    return out


def bucketed(pieces: list[bytes], own: list[int], kind: Features) -> tuple[np.ndarray, np.ndarray]:
    """The pieces' owned features: the number of the piece and the bucket of each."""
    raw = b" ".join(pieces)
    data = np.frombuffer(raw, np.uint8)
    starts, ends = _spans(data)
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    bounds = np.cumsum([0, *(len(p) + 1 for p in pieces)])
    piece = np.searchsorted(bounds, starts, "right") - 1
    first = np.searchsorted(piece, np.arange(len(pieces)))
    owned = np.arange(len(starts)) - first[piece] < np.array(own)[piece]
    state = np.full(len(starts), _ALL, np.uint32)
    owners, found = [], []
    for k in range(kind.n):
        m = len(starts) - k  # runs of k + 1 words that end inside the batch
        if m <= 0:
            break
        state = state[:m]
        if k:
            state = _CRC[(state ^ np.uint32(32)) & 255] ^ (state >> np.uint32(8))
        state = _crc_on(state, data, raw, starts[k : k + m], ends[k : k + m])
        good = owned[:m] & (piece[:m] == piece[k : k + m])
        owners.append(piece[:m][good])
        found.append(((state ^ _ALL) % np.uint32(kind.buckets))[good].astype(np.int64))
    return np.concatenate(owners), np.concatenate(found)


def _in_batches(items: Iterator[tuple], size) -> Iterator[list[tuple]]:
    """Lists of items of about BATCH_BYTES."""
    held, total = [], 0
    for item in items:
        held.append(item)
        total += size(item)
        if total >= BATCH_BYTES:
            yield held
            held, total = [], 0
    if held:
        yield held


class _Corpus:
    """A table of texts as the operator reads it: short ones whole, long ones as dealt chunks."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, kind: Features):
        self.kind, self.id_type = kind, dict(docs.dtypes)[id_col]
        rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
        size = F.octet_length("text")
        self.short = rows.where(size <= DEALT_BYTES)
        n, id_type = kind.n, self.id_type

        def cut_rows(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                for i in range(len(batch)):
                    chunks = list(cut(batch.column(1)[i].as_py(), n)) or [(b"", 0)]
                    for at in range(0, len(chunks), 64):
                        part = chunks[at : at + 64]
                        m = len(part)
                        head = [batch.column(c).take(pa.array([i] * m)) for c in (0, 2)]
                        yield pa.RecordBatch.from_arrays([*head, pa.array(range(at, at + m), pa.int64()), pa.array([o for _, o in part], pa.int64()), pa.array([p for p, _ in part], pa.binary())], ["doc_id", "digest", "chunk", "own", "piece"])

        long = rows.where(size > DEALT_BYTES).withColumn("digest", F.sha2("text", 256))
        chunks = long.mapInArrow(cut_rows, f"doc_id {id_type}, digest string, chunk long, own long, piece binary")
        self.chunks = chunks.repartition(shuffle_parts(docs.sparkSession), "doc_id", "digest", "chunk")

    def counts(self) -> DataFrame:
        """``(bucket, n)``: features per bucket over all texts; a task sends one row per bucket at most."""
        kind = self.kind

        def total(pieces: Iterator[tuple[bytes, int]]) -> Iterator:
            import pyarrow as pa

            seen = np.zeros(kind.buckets, np.int64)
            for part in _in_batches(pieces, lambda p: len(p[0])):
                seen += np.bincount(bucketed([p for p, _ in part], [o for _, o in part], kind)[1], minlength=kind.buckets)
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at], pa.int64())], ["bucket", "n"])

        def of_texts(batches: Iterator) -> Iterator:
            return total(c for batch in batches for t in batch.column(0) for c in cut(t.as_py(), kind.n))

        def of_chunks(batches: Iterator) -> Iterator:
            return total((p.as_py(), o.as_py()) for batch in batches for p, o in zip(batch.column(0), batch.column(1)))

        schema = "bucket long, n long"
        both = self.short.select("text").mapInArrow(of_texts, schema).unionByName(self.chunks.select("piece", "own").mapInArrow(of_chunks, schema))
        return both.groupBy("bucket").agg(F.sum("n").alias("n"))

    def sums(self, gains: np.ndarray) -> DataFrame:
        """``(doc_id, n_words, n_features, gain)`` per document: the sums of its chunks."""
        kind = self.kind
        shared = self.short.sparkSession.sparkContext.broadcast(gains)  # one number per bucket

        def measure(chunks: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
            owner, bucket = bucketed([c[-2] for c in chunks], [c[-1] for c in chunks], kind)
            n = np.bincount(owner, minlength=len(chunks))
            return n, np.bincount(owner, weights=shared.value[bucket], minlength=len(chunks)).astype(np.int64)

        def of_texts(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                out = np.zeros((3, len(batch)), np.int64)
                pieces = ((i, *c) for i, t in enumerate(batch.column(1)) for c in cut(t.as_py(), kind.n))
                for part in _in_batches(pieces, lambda p: len(p[1])):
                    n, gain = measure(part)
                    doc = np.array([p[0] for p in part])
                    np.add.at(out, (slice(None), doc), np.stack([[p[2] for p in part], n, gain]))
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out)], ["doc_id", "n_words", "n_features", "gain"])

        def of_chunks(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                rows = list(zip(batch.column(4).to_pylist(), batch.column(3).to_pylist()))
                got = [measure(part) for part in _in_batches(iter(rows), lambda p: len(p[0]))]
                n, gain = (np.concatenate([g[i] for g in got]) if got else np.empty(0, np.int64) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(n, pa.int64()), pa.array(gain, pa.int64())], ["doc_id", "digest", "chunk", "own", "n", "gain"])

        short = self.short.mapInArrow(of_texts, f"doc_id {self.id_type}, n_words long, n_features long, gain long")
        part = self.chunks.mapInArrow(of_chunks, f"doc_id {self.id_type}, digest string, chunk long, own long, n long, gain long")
        # Repeated rows share a key: they are alike, so each is the sum over the number of first chunks.
        copies = F.count_if(F.col("chunk") == 0)
        long = part.groupBy("doc_id", "digest").agg(copies.alias("copies"), *(F.call_function("div", F.sum(c), copies).alias(a) for c, a in (("own", "n_words"), ("n", "n_features"), ("gain", "gain"))))
        return short.unionByName(long.select("doc_id", "n_words", "n_features", "gain", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).drop("copy"))


def bucket_gains(corpus: DataFrame, target: DataFrame, kind: Features) -> np.ndarray:
    """The gain of every bucket, from the ``(bucket, n)`` tables of both sides."""
    s, t = (np.zeros(kind.buckets, np.int64) for _ in range(2))
    for seen, counts in ((s, corpus), (t, target)):
        for r in counts.collect():  # one row per bucket at most
            seen[r.bucket] = r.n
    total_s, total_t = float(s.sum()), float(t.sum())
    return np.array([math.floor(1000 * math.log((float(b) + 1) * (total_s + kind.buckets) / ((float(a) + 1) * (total_t + kind.buckets)))) for a, b in zip(s.tolist(), t.tolist())], np.int64)


def noise(doc_id: Column, seed: str) -> Column:
    """1000 times standard Gumbel noise, floored, from the id's digest."""
    h = F.conv(F.left(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), F.lit(8)), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, ws: Workspace, *, percent: int = 25, min_words: int = 20, seed: str = "7", kind: Features = Features(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_features, weight, score, rank)`` of every row of ``docs``; rank is null unless the document is drawn.

    Of the documents with ``min_words`` words at least, ``percent`` of a hundred are drawn.
    """
    spark = docs.sparkSession
    corpus, aim = _Corpus(docs, id_col, text_col, kind), _Corpus(target, target.columns[0] if id_col not in target.columns else id_col, "text", kind)
    sums = corpus.sums(bucket_gains(corpus.counts(), aim.counts(), kind))
    n = F.greatest("n_features", F.lit(1).cast("long"))
    weight = F.call_function("div", F.col("gain") - F.pmod(F.col("gain"), n), n)
    scored = sums.select("doc_id", "n_words", "n_features", weight.alias("weight"), (weight + noise(F.col("doc_id"), seed)).alias("score"))
    scored = ws.save(scored, "scored")

    fit = F.col("n_words") >= min_words
    seen = scored.where(fit).groupBy("score").agg(F.count("*").alias("n")).withColumn("band", F.floor(F.col("score") / 256))
    above = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    bands = seen.groupBy("band").agg(F.sum("n").alias("n"))  # some hundreds of rows
    bands = bands.select("band", F.coalesce(F.sum("n").over(above(F.lit(0)).orderBy(F.desc("band"))), F.lit(0)).alias("higher"))
    inside = F.coalesce(F.sum("n").over(above("band").orderBy(F.desc("score"))), F.lit(0))
    places = ws.save(seen.withColumn("inside", inside).join(bands, "band").select("score", "n", (F.col("higher") + F.col("inside")).alias("before")), "places")
    wanted = (places.agg(F.sum("n")).first()[0] or 0) * percent // 100
    least = places.where(F.col("before") < wanted).agg(F.min("score")).first()[0]

    drawn = fit & (F.col("score") >= F.lit(least).cast("long")) if least is not None else F.lit(False)
    tied = F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "weight"))
    rank = F.col("before") + tied
    some = scored.where(drawn).join(places.select("score", "before"), "score").withColumn("rank", rank)
    some = some.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank"))).drop("before")
    rest = scored.where(~drawn).withColumn("rank", F.lit(None).cast("long"))
    return rest.unionByName(some)


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Workspace(spark, "resampling"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


#: DuckDB SQL of the query; the CRC table is derived from its polynomial, features are hashed once each.
ORACLE = r"""
WITH crc AS (
  SELECT list(c ORDER BY i) AS t
  FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))),
texts AS (
  SELECT 0 AS side, row_number() OVER () AS r, doc_id, text FROM documents
  UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
words AS (
  SELECT side, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM texts),
features AS (
  SELECT side, r, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM words),
hexed AS (SELECT f, hex(f) AS h FROM (SELECT DISTINCT f FROM features)),
buckets AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(h), 2), lambda i: (instr('123456789ABCDEF', substr(h, i, 1)) * 16 + instr('123456789ABCDEF', substr(h, i + 1, 1)))::BIGINT)),
                            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM hexed, crc),
placed AS (SELECT side, r, bucket, count(*) AS n FROM features JOIN buckets USING (f) GROUP BY ALL),
sums AS (
  SELECT b.bucket, coalesce(sum(n) FILTER (side = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 1), 0)::DOUBLE AS t
  FROM (SELECT unnest(range(10000)) AS bucket) b LEFT JOIN placed USING (bucket) GROUP BY b.bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM sums),
weights AS (
  SELECT r, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS g FROM placed JOIN gains USING (bucket) WHERE side = 0 GROUP BY r),
scored AS (
  SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_features, 0) AS n_features,
         coalesce((g - ((g % n_features) + n_features) % n_features) // n_features, 0) AS weight,
         list_reduce(list_prepend(0, list_transform(range(1, 9), lambda i: instr('123456789abcdef', substr(sha256('7:' || coalesce(d.doc_id::VARCHAR, '')), i, 1))::BIGINT)), lambda a, x: a * 16 + x) AS h
  FROM words d LEFT JOIN weights USING (r) WHERE d.side = 0),
final AS (SELECT doc_id, n_words, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0)))::BIGINT AS score FROM scored),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS k, count(*) OVER (PARTITION BY n_words >= 20) AS eligible FROM final)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND k <= 25 * eligible // 100 THEN k END AS rank FROM ranked
"""
