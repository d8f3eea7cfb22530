"""Removal of long repeated byte strings with a logarithmic family of suffix indexes.

A byte goes if a string of LENGTH bytes that covers it starts anywhere else,
in the same text or another; strings never cross texts and are judged on the
input.

Suffixes are indexed sparsely.  The anchor of a string of LENGTH bytes is its
least-hashed GRAM-byte part, the leftmost on a tie, which its content alone
decides; so equal strings have equal anchors at equal offsets, and the suffixes
at anchors stand for all.  Neighbouring strings with one anchor are one entry.
A batch's index is its entries.  It is joined with each level of the family, by
hashes of anchors and strings, for those that occur again, then becomes a level
itself; two levels of equal rank become one of the next.  Each entry is thus
rewritten log2(batches) times.  The joins exchange rows by hash: no order of
suffixes inside a level is used, and no longest match is computed.

Entries whose whole string repeats are settled by the scans.  The others get
their bytes fetched once and are cut into pieces of at most STEP strings at
fixed offsets from the anchor; a piece settles if it repeats.  A string can only
repeat if the core that all strings of its piece share does, so single strings
are compared only where a core repeats and its piece does not: at the edges of
long matches.

Nothing is compared in pairs, so thousands of copies cost what they weigh.  Whole
strings and pieces are told apart by two 64-bit hashes each.  The number of
batches follows the bytes, one more for each doubling beyond BATCH_BYTES.

Passages are found apart from that by their words, whatever stands between them:
of any ``PASSAGE`` words in a row, the ``PHRASE`` words of least hash are kept, so two
texts that share a passage of more than 50 words share such a phrase.

Defined results: null and empty texts have no bytes; repeated rows repeat each
other; texts that lose all bytes keep an empty rest; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm.common import Workspace, table, text_or_empty
from orbweave.llm.hashing import Prefix, shingle_hashes, word_hashes

LENGTH, GRAM, STEP = 400, 64, 16
SPAN = LENGTH - GRAM + 1
BATCH_BYTES = 256 << 20
PASSAGE, PHRASE = 51, 24


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each window of ``width``, by running minima of aligned blocks."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def entries(data: np.ndarray) -> list[np.ndarray]:
    """The suffix entries of a text: first start, number of starts, place of the anchor, hashes of anchor and string."""
    n = len(data) - LENGTH + 1
    if n < 1:
        return [np.empty(0, np.int64)] * 5
    prefix = Prefix(data)
    at = np.arange(len(data) - GRAM + 1)
    grams = prefix.hashes(at, at + GRAM)
    least = sliding_min(grams, SPAN)
    start = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    size = np.diff(np.append(start, n))
    starts, places = [], []
    for s, k, a in zip(start.tolist(), size.tolist(), least[start]):
        place = s + np.flatnonzero(grams[s : s + k + SPAN - 1] == a)
        starts.append(np.concatenate([[s], place[:-1][place[:-1] < s + k - 1] + 1]))
        places.append(place[: len(starts[-1])])
    start, place = np.concatenate(starts), np.concatenate(places)
    size = np.diff(np.append(start, n))
    return [start, size, place, grams[place].view(np.int64), prefix.hashes(start, start + size + LENGTH - 1).view(np.int64)]


def pieces(prefix: Prefix, size: int, place: int) -> list[np.ndarray]:
    """Of one entry's bytes: first start and number of starts of each piece, hashes of piece and core."""
    block = np.arange((place - size + 1) // STEP, place // STEP + 1)
    low = np.maximum(0, place - STEP * block - STEP + 1)
    high = np.minimum(size - 1, place - STEP * block)
    core = place - STEP * block
    return [low, high - low + 1, prefix.hashes(low, high + LENGTH).view(np.int64), prefix.hashes(core, core - STEP + 1 + LENGTH).view(np.int64)]


def _entries(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        found, sizes = [], []
        for text in batch.column(1):
            e = entries(np.frombuffer((text.as_py() or "").encode("utf-8", "surrogatepass"), np.uint8))
            found.append(e)
            sizes.append(len(e[0]))
        if not sum(sizes):
            continue
        who = np.repeat(np.arange(len(sizes)), sizes)
        columns = [np.concatenate(x).astype(np.int64) for x in zip(*found)]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who)), *(pa.array(c) for c in columns)], ["rid", "start", "size", "place", "anchor", "string"])


ENTRY = "rid long, start long, size long, place long, anchor long, string long"


class SuffixFamily:
    """Levels of sorted entries; a batch meets each level once."""

    def __init__(self, ws: Workspace):
        self.ws, self.levels, self.entries, self.matches, self.n = ws, {}, [], [], 0

    def add(self, docs: DataFrame) -> None:
        """``docs (rid, text)``: index a batch, note what occurs again, and let equal levels merge."""
        ws, k = self.ws, self.n
        self.n += 1
        own = ws.save(docs.select("rid", "text").mapInArrow(_entries, ENTRY), f"entries{k}")
        self.entries.append(own)
        index = self._sorted(own.withColumn("seen", F.lit(1).cast("long")), f"index{k}")
        again = [self._again(index.where("seen > 1"), "string"), self._again(index.groupBy("anchor").agg(F.sum("seen").alias("n")).where("n > 1").withColumn("string", F.lit(0).cast("long")), "anchor")]
        for level, _ in self.levels.values():
            again.append(self._again(index.join(level.select("anchor", "string"), ["anchor", "string"], "left_semi"), "string"))
            again.append(self._again(index.join(level.select("anchor"), "anchor", "left_semi").withColumn("string", F.lit(0).cast("long")), "anchor"))
        found = again[0]
        for x in again[1:]:
            found = found.unionByName(x)
        self.matches.append(ws.save(found.distinct(), f"again{k}"))
        rank, name = 0, f"index{k}"
        while rank in self.levels:
            other, old = self.levels.pop(rank)
            rank += 1
            index, new = self._sorted(index.unionByName(other), f"level{k}-{rank}"), f"level{k}-{rank}"
            ws.drop(old, name)
            name = new
        self.levels[rank] = index, name

    @staticmethod
    def _again(rows: DataFrame, what: str) -> DataFrame:
        return rows.select(F.lit(what).alias("what"), "anchor", "string")

    def _sorted(self, rows: DataFrame, name: str) -> DataFrame:
        one = rows.groupBy("anchor", "string").agg(F.sum("seen").alias("seen"), F.min(F.struct("rid", "start", "size", "place")).alias("e"))
        return self.ws.save(one.select("anchor", "string", "seen", "e.*").sortWithinPartitions("anchor", "string"), name)

    def index(self) -> DataFrame:
        """All entries, each distinct (anchor, string) once, with its first place."""
        return self._sorted(_union([x for x, _ in self.levels.values()]), "index-all")

    def repeated(self, what: str) -> DataFrame:
        """``(anchor, string)`` of entries, or ``(anchor)``, that occur again."""
        return _union(self.matches).where(F.col("what") == what).select(*(["anchor", "string"] if what == "string" else ["anchor"])).distinct()


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x)
    return out


def _contexts(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        rows = {c: [] for c in ("rid", "start", "size", "place", "string", "open", "bytes")}
        for rid, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            data = text.encode("utf-8", "surrogatepass")
            for e in wanted:
                rows["rid"].append(rid)
                for c in ("start", "size", "place", "string", "open"):
                    rows[c].append(e[c])
                rows["bytes"].append(data[e["start"] : e["start"] + e["size"] + LENGTH - 1])
        longs = [pa.array(rows[c], pa.int64()) for c in ("rid", "start", "size", "place", "string")]
        yield pa.RecordBatch.from_arrays([*longs, pa.array(rows["open"], pa.bool_()), pa.array(rows["bytes"], pa.binary())], list(rows))


CONTEXT = "rid long, start long, size long, place long, string long, open boolean, bytes binary"


def _pieces(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        found, sizes = [], []
        for start, size, place, data in zip(*(batch.column(i).to_pylist() for i in range(4))):
            p = pieces(Prefix(np.frombuffer(data, np.uint8)), size, place - start)
            found.append(p)
            sizes.append(len(p[0]))
        if not sizes:
            continue
        who = pa.array(np.repeat(np.arange(len(sizes)), sizes))
        columns = [pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*found)]
        yield pa.RecordBatch.from_arrays([*(batch.column(i).take(who) for i in (4, 5, 6, 0)), *columns], ["rid", "string", "open", "start", "low", "n", "piece", "core"])


def _windows(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        found, sizes, starts = [], [], []
        for start, data, low, n in zip(*(batch.column(i).to_pylist() for i in range(4))):
            at = np.arange(low, low + n)
            found.append(Prefix(np.frombuffer(data, np.uint8)).hashes(at, at + LENGTH).view(np.int64))
            sizes.append(n)
            starts.append(at + start)
        if not sizes:
            continue
        who = pa.array(np.repeat(np.arange(len(sizes)), sizes))
        yield pa.RecordBatch.from_arrays([batch.column(4).take(who), batch.column(5).take(who), pa.array(np.concatenate(starts)), pa.array(np.concatenate(found))], ["rid", "open", "start", "hash"])


def keyed(docs: DataFrame) -> DataFrame:
    text = text_or_empty()
    return docs.select("doc_id", text.alias("text"), F.xxhash64("doc_id", text).alias("rid"))


def repeated_spans(docs: DataFrame, ws: Workspace, *, batches: int | None = None) -> DataFrame:
    """``(rid, spans)``: the starts (first, number) of repeated strings in each text that has any; ``docs (rid, text)``."""
    family = SuffixFamily(ws)
    if batches is None:
        total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        batches = 2 + (total // BATCH_BYTES).bit_length()
    for k in range(batches):
        family.add(docs.where(F.pmod(F.xxhash64(F.lit(1), "rid"), F.lit(batches)) == k))
    strings, anchors = ws.save(family.repeated("string"), "strings"), ws.save(family.repeated("anchor"), "anchors")
    settled = _union(family.entries).select("rid", "start", "size", "anchor", "string").join(strings, ["anchor", "string"]).select("rid", "start", F.col("size").alias("n"))

    # Entries of repeated anchors that have an unsettled string; one of each settled string beside them.
    index = family.index().join(anchors, "anchor", "left_semi")
    known = strings.withColumn("known", F.lit(True))
    index = ws.save(index.join(known, ["anchor", "string"], "left").withColumn("open", F.col("known").isNull()).drop("known"), "candidates")
    unsettled = ws.save(index.where("open").select("anchor").distinct(), "unsettled")
    wanted = index.join(unsettled, "anchor", "left_semi").groupBy("rid").agg(F.collect_list(F.struct("start", "size", "place", "string", "open")).alias("wanted"))
    wanted = ws.save(wanted, "wanted")
    contexts = ws.save(docs.select("rid", "text").join(wanted, "rid").mapInArrow(_contexts, CONTEXT), "contexts")

    cut = contexts.select("start", "size", "place", "bytes", "rid", "string", "open").mapInArrow(_pieces, "rid long, string long, open boolean, start long, low long, n long, piece long, core long")
    cut = ws.save(cut, "pieces")
    twice = ws.save(cut.groupBy("piece", "core").agg(F.count("*").alias("k")).where("k > 1").select("piece", "core"), "twice")
    open_cut = cut.where("open")
    some = open_cut.join(twice, ["piece", "core"], "left_semi").select("rid", (F.col("start") + F.col("low")).alias("start"), "n")

    single = open_cut.join(twice, ["piece", "core"], "left_anti").select("core").distinct()
    edges = ws.save(cut.groupBy("core").agg(F.count("*").alias("k")).where("k > 1").select("core").join(single, "core", "left_semi"), "edges")
    fine = cut.join(edges, "core", "left_semi").groupBy("piece").agg(F.min(F.struct("string", "low", "n", "open")).alias("p")).select("p.*")
    fine = ws.save(fine, "fine")
    one = contexts.select("string", "start", "bytes", "rid").join(fine, "string").select("start", "bytes", "low", "n", "rid", "open")
    windows = ws.save(one.mapInArrow(_windows, "rid long, open boolean, start long, hash long"), "windows")
    pairs = ws.save(windows.groupBy("hash").agg(F.count("*").alias("k")).where("k > 1").select("hash"), "pairs")
    few = windows.where("open").join(pairs, "hash", "left_semi").select("rid", "start", F.lit(1).cast("long").alias("n"))

    spans = settled.unionByName(some).unionByName(few)
    return ws.save(spans.groupBy("rid").agg(F.array_sort(F.collect_set(F.struct("start", "n"))).alias("spans")), "spans")


def phrases(text: str) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of the phrases of a text that stand for its passages."""
    words = word_hashes(b" ".join(text.encode("utf-8", "surrogatepass").split()))
    if len(words) < PASSAGE:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    hashes, width = shingle_hashes(words, PHRASE), PASSAGE - PHRASE + 1
    least = sliding_min(hashes, width)
    # A phrase stays if it is the least of some window over it: if the greatest of those least ones is its own.
    edge = np.zeros(width - 1, np.uint64)
    kept = ~sliding_min(~np.concatenate([edge, least, edge]), width) == hashes
    at = np.flatnonzero(kept)
    return at, hashes[at].view(np.int64)


def _phrases(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        found = [phrases(t.as_py()) for t in batch.column(2)]
        who = pa.array(np.repeat(np.arange(len(found)), [len(at) for at, _ in found]))
        at, h = (np.concatenate([np.empty(0, np.int64), *x]) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 2
        yield pa.RecordBatch.from_arrays([batch.column(0).take(who), batch.column(1).take(who), pa.array(at), pa.array(h)], ["rid", "text_hash", "at", "phrase"])


def passages(docs: DataFrame, ws: Workspace) -> DataFrame:
    """``(rid, n_passages)``: phrases of each text that occur in other, different texts, neighbouring ones counted as one; ``docs (rid, text)``.

    A text without any has no row.  Copies of one whole text don't count.
    """
    found = ws.save(docs.select("rid", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(_phrases, "rid long, text_hash long, at long, phrase long"), "phrases")
    # Least and greatest hash differ where more than one text has the phrase: no distinct values are gathered.
    shared = found.groupBy("phrase").agg(F.min("text_hash").alias("low"), F.max("text_hash").alias("high")).where("low <> high").select("phrase")
    hit = found.join(ws.save(shared, "shared-phrases"), "phrase", "left_semi").groupBy("rid").agg(F.array_sort(F.collect_set("at")).alias("at"))
    apart = F.size(F.filter(F.zip_with(F.slice("at", 2, 1 << 30), "at", lambda b, a: b - a), lambda d: d > PASSAGE))
    return ws.save(hit.select("rid", (apart + 1).cast("long").alias("n_passages")), "passages")


def cut_out(data: bytes, spans: list[dict]) -> tuple[bytes, int, int]:
    """What is left of a text, and the number of bytes and of maximal runs removed."""
    kept, at, removed, runs, end = [], 0, 0, 0, -1
    for s in spans:
        first, last = s["start"], s["start"] + s["n"] + LENGTH - 1
        if first > end:
            runs += 1
            kept.append(data[at:first])
            removed += last - first
            at = end = last
        elif last > end:
            removed += last - end
            at = end = last
    kept.append(data[at:])
    return b"".join(kept), removed, runs


def remove_repeats(docs: DataFrame, ws: Workspace, *, batches: int | None = None, with_rest: bool = False) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages)`` of each document; on request also the bytes left."""
    rows = keyed(docs)
    spans = repeated_spans(rows.select("rid", "text"), ws, batches=batches)
    found = passages(rows.select("rid", "text"), ws)
    kind = dict(docs.dtypes)["doc_id"]

    def run(parts: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in parts:
            out = []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = text.encode("utf-8", "surrogatepass")
                rest, removed, runs = cut_out(data, found or [])
                out.append((len(data), removed, runs, hashlib.sha256(rest).hexdigest(), *([rest] * with_rest)))
            columns = list(zip(*out)) or [[]] * (4 + with_rest)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            arrays.insert(4, batch.column(3))
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages"] + ["rest"] * with_rest)

    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long" + ", rest binary" * with_rest
    both = rows.join(spans, "rid", "left").join(found, "rid", "left")
    return both.select("doc_id", "text", "spans", F.coalesce("n_passages", F.lit(0)).cast("long")).mapInArrow(run, schema)


def op9_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and ``n_passages``: passages of over 50 words that other texts share, many of which are shorter than 400 bytes."""
    return remove_repeats(table(spark, sf_dir, "documents"), Workspace(spark, "suffix"))
