"""SimHash near-duplicates through a hierarchical index in Gray order.

Distinct fingerprints are sorted by their rank in the Gray code, so neighbours
differ in few bits, and cut into leaves.  A node above keeps the bits that all
of its fingerprints share, as the AND and the OR of its children.  Two nodes
are compared by the shared bits in which they surely differ; a pair over the
radius is pruned with all that is below.  The descent is a chain of equi-joins
on the parent's number.  Within two leaves the same tree goes on down to groups
of 64 fingerprints, which are compared in full.

A pair of leaves yields a spanning forest of its links, not the links: at most
one edge per fingerprint, however many copies resemble one another.

Defined results: a text without words (null, empty, white space) has
fingerprint 0, which links like any other; repeated rows get equal results;
documents with a null id count but never name a component unless all of its ids
are null; columns besides id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm.common import Workspace, fresh, table, text_or_empty
from orbweave.llm.components import connected_components, merge_labels
from orbweave.llm.hashing import mix, shingle_hashes, word_hashes
from orbweave.llm.stars import Fit, candidates, every_pair, unsettled

SEED = 42
LEAF, GROUP, FAN_BITS = 65536, 64, 3


def fingerprint(text: str, shingle: int = 3) -> int:
    """Signed 64-bit SimHash of the shingles of a text, repeats included."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        parts = [b" ".join(words)]
    else:
        parts = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)))))
    hashes = np.array([digest(p, SEED) for p in parts], "<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, *, shingle: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``fp``; one pass over the texts, no shuffle."""
    kinds = dict(docs.dtypes)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            fps = [fingerprint(x.as_py(), shingle) for x in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(fps, pa.int64())], [*keep, "fp"])

    rows = docs.select(*keep, text_or_empty().alias("_text"))
    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "fp long"]))


def gray_rank(fp: Column) -> Column:
    """Rank of a fingerprint in the Gray code, shifted so that signed order is its order."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp.bitwiseXOR(F.lit(-(2**63)))


def _leaves(batches: Iterator) -> Iterator:
    """Cut a sorted partition into leaves of at most LEAF fingerprints."""
    import pyarrow as pa
    from pyspark import TaskContext

    part, at, rest = TaskContext.get().partitionId(), 0, np.empty(0, np.int64)
    kinds = [("part", pa.int32()), ("at", pa.int32()), ("ones", pa.int64()), ("any", pa.int64()), ("fps", pa.binary())]
    for batch in [*batches, None]:
        if batch is not None:
            rest = np.concatenate([rest, batch.column(0).to_numpy(zero_copy_only=False)])
        while len(rest) >= LEAF or batch is None and len(rest):
            fps, rest = rest[:LEAF], rest[LEAF:]
            values = [part, at, np.bitwise_and.reduce(fps), np.bitwise_or.reduce(fps), fps.astype("<i8").tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, (_, k) in zip(values, kinds)], [name for name, _ in kinds])
            at += 1


def leaf_links(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two leaves of unsigned fingerprints, as positions in both together."""
    shift = 0 if same else len(a)
    label = np.arange(len(a) + (0 if same else len(b)))
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def groups(x):
        at = np.arange(0, len(x), GROUP)
        padded = np.concatenate([x, np.repeat(x[-1:], -len(x) % GROUP)]).reshape(-1, GROUP)
        return padded, np.bitwise_and.reduceat(x, at), np.bitwise_or.reduceat(x, at)

    xs, x_ones, x_any = groups(a)
    ys, y_ones, y_any = groups(b)
    for rows in range(0, len(xs), 256):
        here = slice(rows, rows + 256)
        differ = np.bitwise_count((x_ones[here, None] & ~y_any[None, :]) | (y_ones[None, :] & ~x_any[here, None]))
        gx, gy = np.nonzero(differ <= radius)
        gx += rows
        if same:
            gx, gy = gx[gx <= gy], gy[gx <= gy]
        for at in range(0, len(gx), 64):
            p, q = gx[at : at + 64], gy[at : at + 64]
            apart = np.bitwise_count(xs[p][:, :, None] ^ ys[q][:, None, :])
            near = np.flatnonzero(apart.ravel() <= radius)
            if not len(near):
                continue
            k, i, j = np.unravel_index(near, apart.shape)
            i, j = p[k] * GROUP + i, q[k] * GROUP + j
            real = (i < len(a)) & (j < len(b)) & ((i < j) if same else True)
            i, j = i[real], j[real] + shift
            needed = merge_labels(label, i, j)
            found.append((i[needed], j[needed]))
    none = np.empty(0, np.int64)
    return tuple(np.concatenate([none, *(f[side] for f in found)]) for side in (0, 1))


def gray_index(distinct: DataFrame, ws: Workspace, *, radius: int, tag: str = "gray") -> tuple[DataFrame, DataFrame]:
    """Pairs ``(a, b)`` of leaves that may hold links within ``radius``, and the leaves ``(id, fps)``; ``distinct (fp)`` has each once."""
    n = distinct.count()
    rank = gray_rank(F.col("fp"))
    ranked = distinct.select("fp").repartitionByRange(max(1, -(-n // LEAF)), rank).sortWithinPartitions(rank)
    leaves = ws.save(ranked.mapInArrow(_leaves, "part int, at int, ones long, any long, fps binary"), f"{tag}-leaves")
    size = leaves.agg(F.max("part"), F.max("at")).first()
    per_part = 1 + (size[1] or 0)
    leaves = leaves.withColumn("id", F.col("part").cast("long") * per_part + F.col("at"))
    count, height = (1 + (size[0] or 0)) * per_part, 0
    while count > 1 << FAN_BITS * height:
        height += 1

    pairs = distinct.sparkSession.range(1).select(F.col("id").alias("a"), F.col("id").alias("b"))
    for level in range(height - 1, -1, -1):
        node = F.shiftright("id", FAN_BITS * level)
        nodes = leaves.groupBy(node.alias("node")).agg(F.expr("bit_and(ones)").alias("ones"), F.expr("bit_or(any)").alias("any"))
        below = lambda s: nodes.select(*[F.col(c).alias(f"{c}_{s}") for c in nodes.columns], F.shiftright("node", FAN_BITS).alias(s))  # noqa: B023, E731
        apart = F.expr("bit_count((ones_a & ~any_b) | (ones_b & ~any_a))")
        pairs = pairs.join(below("a"), "a").join(below("b"), "b").where((F.col("node_a") <= F.col("node_b")) & (apart <= radius))
        pairs = ws.save(pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")), f"{tag}-pairs{level}")
    return pairs, leaves.select("id", "fps")


def index_links(pairs: DataFrame, leaves: DataFrame, *, radius: int) -> DataFrame:
    """``(a, b)`` fingerprints linked by a spanning forest of each pair of leaves; a leaf's pair with itself carries it once."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                x, y = (batch.column(i)[k].as_py() for i in (0, 1))
                i, j = leaf_links(np.frombuffer(x, "<u8"), np.frombuffer(x if y is None else y, "<u8"), radius, y is None)
                fps = np.frombuffer(x if y is None else x + y, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(fps[i]), pa.array(fps[j])], ["a", "b"])

    own = pairs.where("a = b").join(leaves.toDF("a", "x"), "a").select("x", F.lit(None).cast("binary").alias("y"))
    two = pairs.where("a <> b").join(leaves.toDF("a", "x"), "a").join(leaves.toDF("b", "y"), "b").select("x", "y")
    return own.unionByName(two).mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, ws: Workspace, *, shingle: int = 3, radius: int = 3) -> DataFrame:
    """``(doc_id, fp, component_id)``: the least id of the documents reachable over links."""
    fps = ws.save(fingerprints(docs, shingle=shingle), "fps")
    distinct = ws.save(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    links = ws.save(index_links(*gray_index(distinct, ws, radius=radius), radius=radius), "links")
    roots = connected_components(links, ws)
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = ws.save(rooted, "rooted")
    least = ws.save(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    named = ws.save(rooted.join(least, "root").select("fp", "component_id"), "named")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


SIMILARITY, WORDS, LEAST = 0.8, 5, 8
#: Distance of the fingerprints of candidates that share a shingle: at similarity 0.8 a bit differs with probability 0.15,
#: so one pair in a thousand lies beyond.
WIDE_RADIUS = 20


def shingle_set(text: str) -> np.ndarray:
    """Distinct hashes, ascending, of the five-word shingles of a text (of all its words, if it has fewer)."""
    words = word_hashes(b" ".join(text.encode("utf-8", "surrogatepass").lower().split()))
    return np.unique(shingle_hashes(words, max(1, min(WORDS, len(words)))))


def set_fingerprint(hashes: np.ndarray) -> int:
    """Signed 64-bit SimHash of distinct 64-bit hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        own = hashes[at : at + 4096]
        counts += np.unpackbits(own.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def first_shingles(shingles: np.ndarray, similarity: float) -> np.ndarray:
    """Of ascending hashes those of which any set as alike shares one."""
    return shingles[: len(shingles) - math.ceil(len(shingles) * similarity - 1e-9) + 1]


def class_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes are in each of some classes by leading bits: a power of two of them, one or two hashes a class; 255 is that many or more."""
    classes = 1 << max(4, len(hashes).bit_length() - 1)
    counts = np.bincount((hashes >> np.uint64(65 - classes.bit_length())).astype(np.int64), minlength=classes)
    return np.minimum(counts, 255).astype(np.uint8)


def most_common(x: np.ndarray, y: np.ndarray) -> int:
    """How many members two sets have in common at most, by their ``class_counts``."""
    if len(x) > len(y):
        x, y = y, x
    if (x == 255).any() or (y == 255).any():
        return 1 << 62
    if len(y) > len(x):
        y = y.reshape(len(x), -1).sum(axis=1, dtype=np.int32)
    return int(np.minimum(x, y).sum(dtype=np.int64))


def _may_be_alike(similarity: float):
    """Of rows ``(a, b, size_a, size_b, counts_a, counts_b)`` the pairs that ``most_common`` doesn't tell apart."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            sizes = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            counts = [[np.frombuffer(x.as_py(), np.uint8) for x in batch.column(i)] for i in (4, 5)]
            common = np.array([most_common(x, y) for x, y in zip(*counts)], np.int64)
            yield batch.filter(pa.array(common >= similarity * (sizes - common))).select(["a", "b"])

    return run


def _sketch(similarity: float):
    """Per text: number of its distinct five-word shingles, their SimHash and class counts, as keys the least of each of LEAST classes of them, and the first of them."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            sizes, fps, keys, firsts, counts = [], [], [], [], []
            for text in batch.column(1):
                shingles = shingle_set(text.as_py())
                sizes.append(len(shingles))
                fps.append(set_fingerprint(shingles))
                counts.append(class_counts(shingles).tobytes())
                first = np.unique(shingles >> np.uint64(3) & np.uint64(LEAST - 1), return_index=True)[1]
                keys.append(mix(shingles[first] + np.uint64(1)).view(np.int64) if len(shingles) else [0])
                firsts.append(first_shingles(shingles, similarity).view(np.int64) if len(shingles) else [0])
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (keys, firsts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(fps, pa.int64()), *lists, pa.array(counts, pa.binary())], ["id", "size", "fp", "keys", "first", "counts"])

    return run


def _shingles(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        sets = [shingle_set(t.as_py()).view(np.int64) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "shingles"])


def _similar(links: DataFrame, items: DataFrame, rows: DataFrame, ws: Workspace, similarity: float, tag: str) -> DataFrame:
    """Of ``(a, b)`` pairs of texts, those whose sets of five-word shingles are alike.

    Pairs meet with the class counts of ``items``, a tenth of their sets, and those that are left with the sets.
    """
    told = lambda s: items.select(*[F.col(c).alias(d) for c, d in (("id", s), ("size", f"size_{s}"), ("counts", f"counts_{s}"))])
    beside = links.distinct().join(told("a"), "a").join(told("b"), "b")
    open_ = beside.select("a", "b", "size_a", "size_b", "counts_a", "counts_b").mapInArrow(_may_be_alike(similarity), "a long, b long")
    links = ws.save(open_, f"{tag}-pairs")
    ws.release()
    ends = ws.save(links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).distinct(), f"{tag}-ends")
    sets = ws.save(rows.join(ends, "id", "left_semi").dropDuplicates(["id"]).mapInArrow(_shingles, "id long, shingles array<long>"), f"{tag}-sets")
    ws.release()
    common = F.size(F.array_intersect("x", "y"))
    alike = F.size("x") + F.size("y") - common
    both = links.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    found = ws.save(both.where((common >= similarity * alike) | (F.size("x") + F.size("y") == 0)).select("a", "b"), f"{tag}-verified")
    ws.drop(f"{tag}-sets", f"{tag}-ends", f"{tag}-pairs")
    ws.release()
    return found


def deduplicate(docs: DataFrame, ws: Workspace, *, radius: int = 3, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each group of near copies: the one with the least id; columns as before.

    Texts are near copies if the similarity of their sets of five-word shingles
    reaches the threshold.  Fingerprints within ``radius`` come from the index in
    Gray order.  That similarity allows more bits than an index can search (0.8
    moves ten on average), so texts that share a least shingle and lie within
    WIDE_RADIUS bits are candidates too; they meet as ``stars`` pairs them.  These
    two settle large groups; then no link is left out: of n shingles two near copies
    share ``similarity * n`` at least, so they share one of the first
    ``(1 - similarity) * n + 1`` in the order of hashes, and all texts that do and
    are still apart are compared.  All candidates are verified by the exact
    similarity, after a bound that leaves out none which reaches it.  Texts without words are copies of one another.
    """
    key, kept_id = fresh(docs, "text_id"), fresh(docs, "kept_id")
    text = text_or_empty()
    rows = docs.select(F.xxhash64(text).alias("id"), text.alias("text"))
    ids = ws.save(docs.select(F.col("doc_id"), F.xxhash64(text).alias("id")).groupBy("id").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("seen")), "ids")
    sketches = ws.save(rows.mapInArrow(_sketch(similarity), "id long, size int, fp long, keys array<long>, first array<long>, counts binary"), "sketches")
    items = ws.save(sketches.dropDuplicates(["id"]).join(ids.select("id", "seen"), "id"), "items")
    ws.drop("sketches")
    ws.release()

    one = ws.save(items.groupBy("fp").agg(F.min("id").alias("a")), "one")
    links = ws.save(index_links(*gray_index(one.select("fp"), ws, radius=radius, tag="near"), radius=radius), "near-links")
    named = lambda side: one.select(F.col("fp").alias(side), F.col("a").alias(f"id_{side}"))
    close = links.join(named("a"), "a").join(named("b"), "b").select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    equal = items.join(one, "fp").where("a <> id").select("a", F.col("id").alias("b"))
    fit = Fit(similarity, WIDE_RADIUS, thorough=True)
    shared = candidates(items.withColumnRenamed("seen", "rank"), fit)
    good = _similar(close.unionByName(equal).unionByName(shared), items, rows, ws, similarity, "near")
    roots = connected_components(good, ws, "near-cc")
    rest = unsettled(items.select("id", "size", F.col("first").alias("keys")), roots, similarity, placed=True)
    more = _similar(every_pair(rest, similarity), items, rows, ws, similarity, "near-rest")
    roots = connected_components(good.unionByName(more), ws, "near-cc-rest") if not more.isEmpty() else roots
    rooted = ws.save(ids.join(roots.toDF("id", "root"), "id", "left").withColumn("root", F.coalesce("root", "id")), "rooted")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "id"))
    stays = ws.save(rooted.groupBy("root").agg(least.alias("stays")).select(F.col("stays.doc_id").alias(kept_id), F.col("stays.id").alias(key)), "stays")
    kept = docs.withColumn(key, F.xxhash64(text)).join(stays, key).where(F.col("doc_id").eqNullSafe(F.col(kept_id)))
    return kept.dropDuplicates([key]).select(*docs.columns)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), Workspace(spark, "simhash"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
