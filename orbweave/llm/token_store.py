"""Token ids as binary blocks: one zstandard frame per document under a shared dictionary.

A store is three tables in a shared folder:

* ``dictionary``: one row, the zstandard dictionary and its SHA-256;
* ``blocks``: per block its shard, its place in the shard, the ids of its
  documents, their counts and CRCs, the offset index, and the frames end to end.
  Documents come in ascending order of their ids: shards are ranges of ids, and
  a block ends at ``BLOCK_BYTES`` of frames or ``BLOCK_DOCS`` documents;
* ``shards``: the number of ids before each shard.

One short document costs one block's index and one frame (``TokenStore.lookup``):
the least and greatest id of a block are columns, so others are skipped by
Parquet's statistics.  Every block names the digest of its dictionary; reading
with another one raises, and so does a frame whose CRC has changed.

Texts are encoded by the tokenizers library.  Its pre-tokenizer's pieces are cut
first, each distinct piece is given to the library's model (the latest
``KEPT_PIECES`` to twice as many are kept per Python worker), and a text with a code point whose class
Python and the library may see differently goes to the library whole.  The dictionary is
trained on a bounded sample: the first ``SAMPLE_CHARS`` characters of the
``SAMPLE_DOCS`` documents of least hashed id.  It changes sizes, never ids.

Defined results: a null text is empty and yields the end id alone; documents
with a null id come last; of rows with one id, those of fewer tokens come
first, then those of lesser CRC; an empty table is a store without blocks; a
sample too small to train leaves the dictionary empty.  Columns other than id
and text are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbweave.llm.bpe import byte_letters, default_path
from orbweave.llm.common import Workspace, shuffle_parts, table

SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 2000, 4096, 65536
BLOCK_BYTES, BLOCK_DOCS, SHARD_BYTES = 1 << 20, 4096, 256 << 20
KEPT_PIECES, KEPT_LENGTH, LEVEL = 500_000, 64, 3

#: White space as the pre-tokenizer takes it (Unicode White_Space).
SPACE = r"\t-\r \x85\xa0  -     　"


#: Categories that the pieces' pattern doesn't settle: Python counts the numbers Nl and No as letters, and knows other unassigned code points.
UNSETTLED = {"Nl", "No", "Cn", "Cs"}


#: Letters of most European languages (Latin-1 to Extended-B); with other letters, numbers or spaces a text takes the general pattern.
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
_LATIN = re.compile(f"[{LATIN}]").fullmatch


class LibraryEncoder:
    """Ids of texts as little-endian arrays."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        data = json.loads(spec)
        data["truncation"] = data["padding"] = None
        self.library = Tokenizer.from_str(json.dumps(data))
        size = max([*data["model"]["vocab"].values(), *(x["id"] for x in data["added_tokens"])]) + 1
        self.kind, self.code = ("<u2", "H") if size <= 1 << 16 else ("<u4", "I")
        self.model = self.library.model
        self.letters = {b: letter for letter, b in byte_letters().items()}
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        contracted = "'(?:[stmd]|re|ve|ll)"
        self.cut = re.compile(rf" ?[^\W\d_]++|{contracted}| ?\d++| ?(?:[^\w{SPACE}]|_)++|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+").findall
        self.cut_latin = re.compile(rf" ?[{LATIN}]++|{contracted}| ?[0-9]++| ?[^\t-\r {LATIN}0-9]++|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+").findall
        self.special = [x["content"] for x in data["added_tokens"]]
        self.settled: set[str] = set()
        self.latin: set[str] = set(map(chr, range(128)))

    def _piece(self, piece: str) -> bytes:
        found = self.kept.get(piece) or self.older.get(piece)
        if found is None:
            letters = piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)
            found = array(self.code, [x.id for x in self.model.tokenize(letters)]).tobytes()
        if len(piece) <= KEPT_LENGTH:
            if len(self.kept) >= KEPT_PIECES:
                self.older, self.kept = self.kept, {}
            self.kept[piece] = found
        return found

    def _cut(self, text: str) -> list[str] | None:
        """The pieces of a text; None if the library must have it whole, as it names a special token or has a code point without a settled class."""
        if any(x in text for x in self.special):
            return None
        if text.isascii():
            return self.cut_latin(text)
        own = set(text)
        for c in own - self.settled:
            kind = unicodedata.category(c)
            if kind in UNSETTLED:
                return None
            self.settled.add(c)
            if _LATIN(c) or kind[0] in "PSM":
                self.latin.add(c)
        return (self.cut_latin if own <= self.latin else self.cut)(text)

    def encode(self, text: str) -> bytes:
        pieces = self._cut(text)
        if pieces is None:
            return array(self.code, self.library.encode(text, add_special_tokens=False).ids).tobytes()
        found, at = list(map(self.kept.get, pieces)), 0
        for _ in range(found.count(None)):
            at = found.index(None, at)
            found[at] = self._piece(pieces[at])
        return b"".join(found)


_ENCODERS: dict[str, LibraryEncoder] = {}


def _encoder(spec: str) -> LibraryEncoder:
    """One encoder per Python worker and tokenizer."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = LibraryEncoder(spec)
    return _ENCODERS[key]


def train_dictionary(spark: SparkSession, docs: DataFrame, spec: str, end_id: int, *, id_col: str, text_col: str) -> bytes:
    """A zstandard dictionary of a sample's serialized ids; empty if the sample is too small.

    About twice SAMPLE_DOCS rows of low hashes reach the driver, whatever the number
    of tasks, of at most SAMPLE_CHARS characters each.
    """
    import zstandard

    share = min(1.0, 2 * SAMPLE_DOCS / max(1, docs.count()))
    some = docs.where(F.xxhash64(id_col, text_col) <= min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63)))
    head = some.select(F.xxhash64(id_col, text_col).alias("h"), F.left(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(SAMPLE_CHARS)).alias("text"))
    encoder = _encoder(spec)
    end = end_id.to_bytes(2 if encoder.kind == "<u2" else 4, "little")
    sample = [encoder.encode(r.text) + end for r in head.orderBy("h", "text").limit(SAMPLE_DOCS).collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few or too short samples
        return b""


def write_tokens(docs: DataFrame, ws: Workspace, *, end_id: int, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None) -> "TokenStore":
    """Encode ``docs``, append ``end_id`` to each, and write the store to ``ws``.

    Texts are encoded once; only compressed frames are sorted by id.
    """
    spark = docs.sparkSession
    with open(tokenizer_path or default_path(), encoding="utf-8") as f:
        spec = f.read()
    trained = train_dictionary(spark, docs, spec, end_id, id_col=id_col, text_col=text_col)
    digest = hashlib.sha256(trained).hexdigest()
    ws.save(spark.createDataFrame([(digest, bytearray(trained))], "digest string, dictionary binary"), "dictionary")
    shared = spark.sparkContext.broadcast((spec, trained))  # the tokenizer's file and DICTIONARY_BYTES at most
    kind = dict(docs.dtypes)[id_col]

    def frames(batches: Iterator) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa

        encoder = _encoder(shared.value[0])
        packer = _packer(shared.value[1])
        end = np.array([end_id], encoder.kind).tobytes()
        for batch in batches:
            counts, crcs, packed = [], [], []
            for text in batch.column(1):
                ids = encoder.encode(text.as_py() or "") + end
                counts.append(len(ids) // len(end))
                crcs.append(zlib.crc32(np.frombuffer(ids, encoder.kind).astype("<u4").tobytes()))
                packed.append(packer.compress(ids))
            sizes = [len(x) for x in packed]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64()), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())], ["id", "n_tokens", "crc", "size", "frame"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    packed = ws.save(rows.mapInArrow(frames, f"id {kind}, n_tokens long, crc long, size long, frame binary"), "frames")
    total = packed.agg(F.sum("size")).first()[0] or 0
    parts = max(shuffle_parts(spark), -(-total // SHARD_BYTES))
    order = [F.col("id").asc_nulls_last(), F.col("n_tokens").asc(), F.col("crc").asc()]
    dealt = packed.repartitionByRange(parts, order[0]).sortWithinPartitions(*order).withColumn("shard", F.spark_partition_id())
    width = 2 if _encoder(spec).kind == "<u2" else 4

    def blocks(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["shard", "block", "start", "first_id", "last_id", "width", "digest", "ids", "counts", "crcs", "offsets", "frames"]
        block = start = 0
        held: list[tuple] = []
        size = 0

        def row() -> pa.RecordBatch:
            ids, counts, crcs, parts_ = zip(*held)
            known = [i for i in ids if i is not None]
            offsets = [0]
            for x in parts_:
                offsets.append(offsets[-1] + len(x))
            values = [shard, block, start, known[0] if known else None, known[-1] if known else None, width, digest, list(ids), list(counts), list(crcs), offsets, b"".join(parts_)]
            kinds = [pa.int32(), pa.int64(), pa.int64(), id_type, id_type, pa.int32(), pa.string(), pa.list_(id_type), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

        for batch in batches:
            id_type = batch.column(0).type
            for i, n, crc, frame, shard_ in zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 4, 5))):
                if held and (size + len(frame) > BLOCK_BYTES or len(held) >= BLOCK_DOCS):
                    yield row()
                    block, start, held, size = block + 1, start + sum(h[1] for h in held), [], 0
                shard = shard_
                held.append((i, n, crc, frame))
                size += len(frame)
        if held:
            yield row()

    schema = f"shard int, block long, start long, first_id {kind}, last_id {kind}, width int, digest string, ids array<{kind}>, counts array<long>, crcs array<long>, offsets array<long>, frames binary"
    saved = ws.save(dealt.mapInArrow(blocks, schema), "blocks")
    sizes = saved.groupBy("shard").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n"))
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))  # one row per shard
    ws.save(sizes.select("shard", F.coalesce(before, F.lit(0)).alias("before")), "shards")
    ws.drop("frames")
    return TokenStore(ws)


def _packer(trained: bytes):
    import zstandard

    if not trained:
        return zstandard.ZstdCompressor(level=LEVEL)
    data = zstandard.ZstdCompressionDict(trained)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=data)


class TokenStore:
    """A written store."""

    def __init__(self, ws: Workspace):
        self.ws = ws

    def read(self, *, with_ids: bool = True) -> DataFrame:
        """``(doc_id, start, n_tokens, ids_crc32)`` of every document, from its decompressed frame, and ``ids`` on request.

        ``start`` counts the ids of all documents before it.
        """
        return self._open(self.ws.load("blocks"), None, with_ids)

    def lookup(self, ids: list, *, with_ids: bool = True) -> DataFrame:
        """As ``read`` for a few ids, named on the driver: other blocks are skipped, and other frames stay packed."""
        wanted = F.lit(False)
        for x in ids:
            wanted = wanted | F.lit(x).between(F.col("first_id"), F.col("last_id"))
        return self._open(self.ws.load("blocks").where(wanted), set(ids), with_ids)

    def _open(self, blocks: DataFrame, wanted: set | None, with_ids: bool) -> DataFrame:
        trained = self.ws.load("dictionary").first()
        if hashlib.sha256(trained.dictionary).hexdigest() != trained.digest:
            raise ValueError("the dictionary doesn't have its digest")
        spark = blocks.sparkSession
        shared = spark.sparkContext.broadcast(bytes(trained.dictionary))  # DICTIONARY_BYTES at most
        own = trained.digest
        kind = dict(blocks.dtypes)["ids"][6:-1]

        def run(batches: Iterator) -> Iterator:
            import zlib

            import numpy as np
            import pyarrow as pa
            import zstandard

            unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(shared.value)) if shared.value else zstandard.ZstdDecompressor()
            for batch in batches:
                for r in batch.to_pylist():
                    if r["digest"] != own:
                        raise ValueError(f"block {r['shard']}/{r['block']} was written under another dictionary")
                    found, start = [], r["start"]
                    for i, (doc, n, crc) in enumerate(zip(r["ids"], r["counts"], r["crcs"])):
                        if wanted is None or doc in wanted:
                            data = unpacker.decompress(r["frames"][r["offsets"][i] : r["offsets"][i + 1]])
                            ids = np.frombuffer(data, f"<u{r['width']}").astype("<u4")
                            now = zlib.crc32(ids.tobytes())
                            if now != crc or len(ids) != n:
                                raise ValueError(f"document {doc} of block {r['shard']}/{r['block']} is damaged")
                            found.append((doc, r["shard"], start, len(ids), now, ids.astype(np.int32) if with_ids else None))
                        start += n
                    if found:
                        columns = list(zip(*found))
                        kinds = [batch.schema.field("ids").type.value_type, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                        arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
                        names = ["doc_id", "shard", "at", "n_tokens", "ids_crc32"]
                        if with_ids:
                            ends = np.cumsum([0, *map(len, columns[5])], dtype=np.int32)
                            arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(columns[5]))))
                            names.append("ids")
                        yield pa.RecordBatch.from_arrays(arrays, names)

        needed = blocks.select("shard", "block", "start", "width", "digest", "ids", "counts", "crcs", "offsets", "frames")
        docs = needed.mapInArrow(run, f"doc_id {kind}, shard int, at long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
        found = docs.join(self.ws.load("shards"), "shard")
        return found.select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def op12_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = write_tokens(table(spark, sf_dir, "documents"), Workspace(spark, "tokens"), end_id=2)
    return store.read(with_ids=False)
