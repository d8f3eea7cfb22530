"""Language-model scores by prediction by partial matching, trained on the corpus.

The model is a trie of byte contexts up to ``ORDER`` bytes with the counts of
the symbols that follow.  A symbol that a context has not seen costs an escape
(method C: distinct symbols against all counts) to the next shorter context,
where the symbols of the longer one are excluded; below the empty context all
byte values not yet excluded are equally likely.  A text is its words, lower-cased,
with single spaces, and an end symbol; the contexts before its start are end
symbols.

At scale, neither texts nor the trie are gathered.  Documents are dealt into
blocks of about ``BLOCK_BYTES``.  Each block asks for the strings of
``ORDER + 1`` bytes and the words that it holds, once each and with its training
counts; requests are dealt by the last three context bytes, so that a bucket
holds every longer context of its branch of the trie and can price its strings;
and the answers go back to the blocks.  Only the orders up to 2 are shared by
all, and they are bounded by the alphabet (2**24 entries).

Defined results: null and empty texts are the end symbol alone; repeated rows
train and are scored once each; a null id is the empty text for the split;
without training rows every byte costs log10(256); extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm.common import Workspace, table, text_or_empty
from orbweave.llm.hashing import mix, word_hashes

ORDER, LOW = 5, 2
BLOCK_BYTES = 12 << 20
CHUNK_BYTES = 1 << 20
END = b"\n"  # no word holds it
END_TOKEN = np.uint64(0x0123456789ABCDEF)
STRINGS, WORDS, LOWS, TOTALS = 0, 1, 2, 3


def normal_text(text: str | None) -> bytes:
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())


def packed_strings(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Each position's ORDER bytes before it and its own byte, as one number; and the positions per text."""
    data = np.frombuffer(b"".join([END * ORDER + t + END for t in texts]), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts])
    n = len(data) - ORDER
    packed = np.zeros(n, np.int64)
    for k in range(ORDER + 1):
        packed <<= 8
        packed |= data[k : k + n]
    body = np.ones(n, bool)
    starts = np.cumsum(sizes + ORDER)[:-1]
    for k in range(ORDER):
        body[starts - ORDER + k] = False
    return packed[body], sizes


def tokens(text: bytes) -> np.ndarray:
    return np.append(word_hashes(text), END_TOKEN)


class Counter:
    """Counts of numbers, merged as chunks arrive; memory follows the distinct ones."""

    def __init__(self, kind):
        self.keys, self.counts = np.empty(0, kind), np.empty(0, np.int64)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        both, at = np.unique(np.concatenate([self.keys, keys]), return_inverse=True)
        self.counts = np.bincount(at, np.concatenate([self.counts, counts]), len(both)).astype(np.int64)
        self.keys = both


def chunks(texts: list[bytes], flags: list[bool]) -> Iterator[tuple[list[bytes], list[bool]]]:
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK_BYTES or i + 1 == len(texts):
            yield texts[at : i + 1], flags[at : i + 1]
            at, size = i + 1, 0


def block_requests(texts: list[bytes], training: list[bool], n_buckets: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(kind, bucket, keys, training counts) of a block's strings and words."""
    strings, words = Counter(np.int64), Counter(np.uint64)
    for part, flags in chunks(texts, training):
        packed, sizes = packed_strings(part)
        keys, at = np.unique(packed, return_inverse=True)
        weight = np.repeat(np.array(flags, float), sizes)
        strings.add(keys, np.bincount(at, weight, len(keys)).astype(np.int64))
        found = [tokens(t) for t in part]
        weight = np.repeat(np.array(flags, float), [len(f) for f in found])
        keys, at = np.unique(np.concatenate(found), return_inverse=True)
        words.add(keys, np.bincount(at, weight, len(keys)).astype(np.int64))
    if not len(strings.keys):
        return
    for kind, c, branch in ((STRINGS, strings, (strings.keys >> 8).astype(np.uint64) & np.uint64(0xFFFFFF)), (WORDS, words, words.keys)):
        bucket = (mix(branch) >> np.uint64(33)) % np.uint64(n_buckets)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
        for b in range(n_buckets):
            own = order[edges[b] : edges[b + 1]]
            if len(own):
                yield kind, b, c.keys[own].tobytes(), c.counts[own].tobytes()
    low, at = np.unique(strings.keys & 0xFFFFFF, return_inverse=True)
    yield LOWS, 0, low.tobytes(), np.bincount(at, strings.counts, len(low)).astype(np.int64).tobytes()


class Level:
    """One order of the trie: counts by (context, symbol), and sums by context."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        seen = counts > 0
        self.keys, self.counts = keys[seen], counts[seen]
        self.contexts, at = np.unique(self.keys >> 8, return_inverse=True)
        self.total = np.bincount(at, self.counts, len(self.contexts))
        self.distinct = np.bincount(at, minlength=len(self.contexts))
        self.at = at

    @staticmethod
    def _find(table: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
        if not len(table):
            return np.zeros(len(keys))
        i = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return np.where(table[i] == keys, values[i], 0)

    def count(self, keys: np.ndarray) -> np.ndarray:
        return self._find(self.keys, keys, self.counts)

    def of_context(self, contexts: np.ndarray, values: np.ndarray) -> np.ndarray:
        return self._find(self.contexts, contexts, values)

    def excluded_below(self, below: "Level", mask: int) -> np.ndarray:
        """Per context: the counts, one order down, of the symbols it has seen."""
        return np.bincount(self.at, below.count(self.keys & mask), len(self.contexts))


def shorter(keys: np.ndarray, counts: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray]:
    cut, at = np.unique(keys & mask, return_inverse=True)
    return cut, np.bincount(at, counts, len(cut))


def prices(keys: np.ndarray, counts: np.ndarray, low_keys: np.ndarray, low_counts: np.ndarray) -> np.ndarray:
    """log10 probability of each packed string's last byte after the bytes before it.

    ``keys`` hold all strings of their branches of the trie, with their training
    counts; ``low_keys`` the counts at order LOW of the whole corpus.
    """
    mask = lambda k: (1 << 8 * (k + 1)) - 1
    levels = {}
    for k in range(ORDER, LOW, -1):
        levels[k] = Level(*((keys, counts) if k == ORDER else shorter(keys, counts, mask(k))))
    for k in range(LOW, -1, -1):
        levels[k] = Level(*((low_keys, low_counts) if k == LOW else shorter(low_keys, low_counts, mask(k))))
    logp = np.zeros(len(keys))
    found = np.zeros(len(keys), bool)
    above_sum = np.zeros(len(keys))  # counts, at this order, of symbols excluded by the order above
    above_distinct = np.zeros(len(keys))
    for k in range(ORDER, -1, -1):
        level = levels[k]
        context = (keys >> 8) & (mask(k) >> 8)
        distinct = level.of_context(context, level.distinct)
        total = level.of_context(context, level.total) - above_sum
        fresh = distinct - above_distinct
        own = level.count(keys & mask(k))
        with np.errstate(divide="ignore", invalid="ignore"):
            hit = np.log10(own / (total + fresh))
            escape = np.log10(fresh / (total + fresh))
        now = ~found & (own > 0)
        logp[now] += hit[now]
        pay = ~found & ~now & (fresh > 0)
        logp[pay] += escape[pay]
        found |= now
        if k:
            above_sum = level.of_context(context, level.excluded_below(levels[k - 1], mask(k - 1)))
            above_distinct = distinct
        else:
            rest = 256 - distinct
            logp[~found] -= np.log10(np.maximum(rest, 1))[~found]
    return logp


def _unpack(rows: list[dict], kind) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.frombuffer(r["keys"], kind) for r in rows]), np.concatenate([np.frombuffer(r["counts"], np.int64) for r in rows])


def score_documents(docs: DataFrame, ws: Workspace) -> DataFrame:
    """Scores of all documents under a model trained on those whose crc32(doc_id) mod 10 is not 0."""
    import pyarrow as pa

    spark = docs.sparkSession
    kind_of_id = dict(docs.dtypes)["doc_id"]
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 0
    text = text_or_empty()
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n_blocks = max(1, -(-size // BLOCK_BYTES))
    n_buckets = max(8, n_blocks)
    rows = docs.select("doc_id", held_out.alias("held_out"), text.alias("text"), F.pmod(F.xxhash64("doc_id", text), F.lit(n_blocks)).alias("block"))

    def ask(batch: pa.Table) -> pa.Table:
        block = batch.column("block")[0].as_py()
        texts = [normal_text(t.as_py()) for t in batch.column("text")]
        training = [not h for h in batch.column("held_out").to_pylist()]
        out = [{"kind": k, "bucket": b, "block": block, "keys": x, "counts": n} for k, b, x, n in block_requests(texts, training, n_buckets)]
        return pa.Table.from_pylist(out, schema=pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())]))

    asked = ws.save(rows.groupBy("block").applyInArrow(ask, "kind int, bucket long, block long, keys binary, counts binary"), "asked")

    def unpacked(batches: Iterator) -> Iterator:
        for batch in batches:
            for r in batch.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r["keys"], np.int64)), pa.array(np.frombuffer(r["counts"], np.int64))], ["key", "n"])

    low = asked.where(F.col("kind") == LOWS).select("keys", "counts").mapInArrow(unpacked, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).orderBy("key").toArrow()
    shared = spark.sparkContext.broadcast((low.column("key").to_numpy(), low.column("n").to_numpy()))  # at most 2**24 entries

    def answer(batch: pa.Table) -> pa.Table:
        asked_rows = batch.to_pylist()
        kind = asked_rows[0]["kind"]
        asked_keys, counts = _unpack(asked_rows, np.int64 if kind == STRINGS else np.uint64)
        keys, at = np.unique(asked_keys, return_inverse=True)
        total = np.bincount(at, counts, len(keys))
        values = prices(keys, total, *shared.value) if kind == STRINGS else total
        out, i = [], 0
        for r in asked_rows:
            n = len(r["keys"]) // 8
            out.append({"kind": kind, "block": r["block"], "keys": r["keys"], "values": values[at[i : i + n]].tobytes(), "n": 0, "distinct": 0})
            i += n
        if kind == WORDS:
            out.append({"kind": TOTALS, "block": -1, "keys": b"", "values": b"", "n": int(total.sum()), "distinct": int((total > 0).sum())})
        return pa.Table.from_pylist(out, schema=pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("values", pa.binary()), ("n", pa.int64()), ("distinct", pa.int64())]))

    answers = asked.where(F.col("kind") != LOWS).groupBy("kind", "bucket").applyInArrow(answer, "kind int, block long, keys binary, values binary, n long, distinct long")
    answers = ws.save(answers, "answers")
    totals = answers.where(F.col("kind") == TOTALS).agg(F.sum("n"), F.sum("distinct")).first()
    n_train, vocabulary = totals[0] or 0, totals[1] or 0
    ws.drop("asked")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        found = {STRINGS: [], WORDS: []}
        for r in right.to_pylist():
            found[r["kind"]].append((np.frombuffer(r["keys"], np.int64 if r["kind"] == STRINGS else np.uint64), np.frombuffer(r["values"], np.float64)))
        lookup = {}
        for kind, parts in found.items():
            keys = np.concatenate([p[0] for p in parts])
            order = np.argsort(keys)
            lookup[kind] = keys[order], np.concatenate([p[1] for p in parts])[order]
        scale = np.log10(n_train + 0.1 * (vocabulary + 1))
        n_tokens, n_known, base, score, per_byte = [], [], [], [], []
        for t in left.column("text"):
            t = normal_text(t.as_py())
            keys, counts = lookup[WORDS]
            c = counts[np.searchsorted(keys, np.sort(tokens(t)))]
            n_tokens.append(len(c))
            n_known.append(int((c > 0).sum()))
            base.append(float(np.log10(c + 0.1).sum() - len(c) * scale))
            keys, values = lookup[STRINGS]
            coded = np.sort(packed_strings([t])[0])
            score.append(float(values[np.searchsorted(keys, coded)].sum()))
            per_byte.append(-score[-1] / np.log10(2) / len(coded))
        columns = [left.column("doc_id"), left.column("held_out"), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array([n_train] * len(base), pa.int64()), pa.array(base), pa.array(score), pa.array(per_byte, pa.float64())]
        return pa.Table.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"])

    schema = f"doc_id {kind_of_id}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    replies = answers.where(F.col("kind") != TOTALS).select("kind", "block", "keys", "values")
    return rows.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(score, schema)


def op3_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), Workspace(spark, "ppm"))
