"""Benchmark decontamination by SimHash of item-sized windows.

For an item of n words, windows of n words of a document are fingerprinted
over their weighted (repeated) five-word shingles.  A multi-index over the
items' fingerprints has eight tables, one per byte, which list for each value
the items whose byte is within two bits of it: by the pigeonhole principle the
eight lists of a window hold every item within ``8 * 3 - 1 = 23`` bits.
Candidates are then verified by the exact similarity of the two multisets of
shingles (sum of least counts over sum of greatest counts).

A window that shares no shingle with an item has similarity 0 to it, so only
windows around a shared shingle are fingerprinted; nothing that could reach the
threshold is left out.  Items are dealt by hash into blocks of about
``block_words`` words; the driver fetches and broadcasts one block at a time, with
one pass over the documents for each.

Defined results: null and empty documents are clean; items without words match
nothing; an item shorter than five words is one shingle of all its words; a
document shorter than an item is one window; repeated rows get equal results;
extra columns pass through ``decontaminate``.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm.common import table
from orbweave.llm.hashing import normal_words, shingle_hashes, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
BLOCK_WORDS = 500_000
FILTER_BITS = 20


def _near_bytes() -> np.ndarray:
    x = np.arange(256, dtype=np.uint8)
    return np.bitwise_count(x[:, None] ^ x[None, :]) <= 2


_NEAR = _near_bytes()
RADIUS = 23


def window_fingerprints(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """SimHash of each stretch of shingle hashes, by differences of running bit counts."""
    low, high = int(starts.min()), int(ends.max())
    bits = np.unpackbits(hashes[low:high].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = np.zeros((high - low + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=counts[1:])
    inside = counts[ends - low] - counts[starts - low]
    return np.packbits(2 * inside > (ends - starts)[:, None], axis=1, bitorder="little").view("<u8").ravel()


class ItemIndex:
    """Fingerprints of a block of items, by their number of words."""

    def __init__(self, items: list[tuple[object, str]], similarity: float = SIMILARITY):
        self.similarity = similarity
        self.items: list[tuple[object, int, Counter, int]] = []  # id, words, shingles, number of shingles
        self.by_size: dict[int, list[int]] = defaultdict(list)
        self.owners: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))  # shingle size, hash: sizes of items
        fps: dict[int, list[int]] = defaultdict(list)
        for item_id, text in items:
            words = word_hashes(normal_words(text or ""))
            if not len(words):
                continue
            size = min(SHINGLE, len(words))
            hashes = shingle_hashes(words, size)
            self.by_size[len(words)].append(len(self.items))
            fps[len(words)].append(int(window_fingerprints(hashes, np.array([0]), np.array([len(hashes)]))[0]))
            self.items.append((item_id, len(words), Counter(hashes.tolist()), len(hashes)))
            for h in hashes.tolist():
                self.owners[size][h].add(len(words))
        self.fps = {n: np.array(x, np.uint64) for n, x in fps.items()}
        self.tables = {n: [self._table(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, b]) for b in range(8)] for n, x in self.fps.items()}
        self.filters = {}
        for size, found in self.owners.items():
            kept = np.zeros(1 << FILTER_BITS, bool)
            kept[np.fromiter(found, np.uint64, len(found)) >> np.uint64(64 - FILTER_BITS)] = True
            self.filters[size] = kept

    @staticmethod
    def _table(bytes_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each value of a byte the items near it: bounds of the lists, and the lists one after another."""
        value, item = np.nonzero(_NEAR[:, bytes_])
        return np.searchsorted(value, np.arange(257)), item

    def within_radius(self, n: int, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (fingerprint, item of n words) within RADIUS, found in the tables of their bytes."""
        blocks, found = fps.astype("<u8").view(np.uint8).reshape(-1, 8), [np.empty(0, np.int64)]
        for b, (bounds, items) in enumerate(self.tables[n]):
            low, count = bounds[blocks[:, b]], bounds[blocks[:, b].astype(int) + 1] - bounds[blocks[:, b]]
            who = np.repeat(np.arange(len(fps)), count)
            place = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
            found.append(who * len(self.fps[n]) + items[place])
        i, j = np.divmod(np.unique(np.concatenate(found)), len(self.fps[n]))
        good = np.bitwise_count(fps[i] ^ self.fps[n][j]) <= RADIUS
        return i[good], j[good]

    def matches(self, text: str | None) -> list[tuple[object, float, int, int]]:
        """(item id, similarity, first word, words) of the best window for each item found."""
        words = word_hashes(normal_words(text or ""))
        best: dict[int, tuple[float, int, int]] = {}
        for size, kept in self.filters.items():
            hashes = shingle_hashes(words, size)
            if not len(hashes):
                continue
            at = np.flatnonzero(kept[hashes >> np.uint64(64 - FILTER_BITS)])
            seeds: dict[int, list[int]] = defaultdict(list)
            for p in at.tolist():
                for n in self.owners[size].get(int(hashes[p]), ()):
                    seeds[n].append(p)
            for n, hit in seeds.items():
                self._windows(size, n, hashes, np.array(hit), best)
        return [(self.items[i][0], *found) for i, found in sorted(best.items())]

    def _windows(self, size: int, n: int, hashes: np.ndarray, hit: np.ndarray, best: dict) -> None:
        wide = n - size + 1  # shingles of a full window
        last = max(0, len(hashes) - wide)
        edge = np.zeros(last + 2, np.int64)
        np.add.at(edge, np.clip(hit - wide + 1, 0, last), 1)
        np.add.at(edge, np.clip(hit, 0, last) + 1, -1)
        starts = np.flatnonzero(np.cumsum(edge)[:-1] > 0)
        ends = np.minimum(starts + wide, len(hashes))
        for lo in range(0, len(starts), 2048):
            s, e = starts[lo : lo + 2048], ends[lo : lo + 2048]
            for w, j in zip(*self.within_radius(n, window_fingerprints(hashes, s, e))):
                i = self.by_size[n][j]
                _, _, own, total = self.items[i]
                window = hashes[s[w] : e[w]].tolist()
                left, common = dict(own), 0
                for h in window:
                    if left.get(h, 0):
                        left[h] -= 1
                        common += 1
                score = common / (len(window) + total - common)
                if score >= self.similarity and score > best.get(i, (0.0,))[0]:
                    best[i] = (score, int(s[w]), int(e[w] - s[w] + size - 1))


def item_blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[object, str]]]:
    """The items in blocks of about ``block_words`` words, one after another on the driver."""
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null")
    words = items.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0] or 0
    n = -(-words // block_words)
    for k in range(n):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items
        found = sorted(((r.item_id, r.text) for r in block.collect()), key=repr)
        if found:
            yield found


_INDEXES: dict[tuple, ItemIndex] = {}


def _index(name: str, block, similarity: float) -> ItemIndex:
    """One index per Python worker and broadcast block."""
    if name not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[name] = ItemIndex(block.value, similarity)
    return _INDEXES[name]


def contamination(docs: DataFrame, benchmark: DataFrame, *, similarity: float = SIMILARITY, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``(doc_id, item_id, similarity, first_word, n_words)``: each item that a document holds, at its best window."""
    kinds, items = dict(docs.dtypes), dict(benchmark.dtypes)
    schema = f"doc_id {kinds['doc_id']}, item_id {items['item_id']}, similarity double, first_word long, n_words long"
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    found = docs.sparkSession.createDataFrame([], schema)
    for block in item_blocks(benchmark, block_words):
        found = found.unionByName(rows.mapInArrow(_finder(docs.sparkSession.sparkContext.broadcast(block), similarity), schema))
    return found


def _finder(block, similarity: float):
    name = uuid.uuid4().hex

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        index = _index(name, block, similarity)
        for batch in batches:
            out, who = [], []
            for k, text in enumerate(batch.column(1)):
                for match in index.matches(text.as_py()):
                    who.append(k)
                    out.append(match)
            if out:
                ids, scores, first, n = zip(*out)
                columns = [batch.column(0).take(pa.array(who)), pa.array(ids), pa.array(scores), pa.array(first, pa.int64()), pa.array(n, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "similarity", "first_word", "n_words"])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, similarity: float = SIMILARITY, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents that hold no item; a map over the documents, without shuffle."""
    for block in item_blocks(benchmark, block_words):
        name, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator, name=name, shared=shared) -> Iterator:
            import pyarrow as pa

            index = _index(name, shared, similarity)
            for batch in batches:
                texts = batch.column(batch.schema.names.index("text"))
                yield batch.filter(pa.array([not index.matches(t.as_py()) for t in texts], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op4_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
