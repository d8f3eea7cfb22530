"""Resampling, the token store and hard negatives against brute force, the tokenizers library and exact round trips."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from orbweave.llm import hard_negatives, resampling, token_store
from orbweave.llm.common import Workspace
from tests.conftest import SMALL

LONG = " ".join(f"w{i % 97}" + ("x" * 90 if i % 1000 == 0 else "") for i in range(9000))
ROWS = [(1, "A b-c d"), (2, None), (3, ""), (4, "  \n\t "), (5, "one two"), (5, "one two"), (None, LONG), (None, LONG), (7, "naïve café 你好 \U0001f600 <|endoftext|> it's \x1c ² Ⅷ \u0378"), (8, "你" * 20000), (9, "tie " * 25), (10, LONG + " more")]
SCHEMA = "doc_id long, text string, Rank int, score string, `digest` string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "s", "d") for i, t in rows], SCHEMA)


def small(spark, name="documents"):
    return spark.read.parquet(f"{SMALL}/{name}.parquet")


def features(text):
    data = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode()
    words = re.findall(rb"[0-9a-z\x80-\xff]+", data)
    return len(words), [zlib.crc32(x) % 10000 for x in words + [a + b" " + b for a, b in zip(words, words[1:])]]


def plain_resampling(docs, target, percent=25):
    docs = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for d in docs for b in d[2]), Counter(b for x in target for b in features(x)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total_s + 10000) / ((s[b] + 1) * (total_t + 10000)))) for b in range(10000)]
    out = []
    for i, n, f in docs:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    for k, r in enumerate(fit[: len(fit) * percent // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("percent", [25, 100, 0])
def test_resampling_of_awkward_rows(spark, percent):
    """Nulls, repeated rows, long and unspaced texts, clashing columns; long texts are dealt as chunks."""
    target = spark.createDataFrame([(1, "one two W5 w6 w7"), (2, None)], "item_id long, text string")
    found = resampling.resample(table(spark, ROWS), target, Workspace(spark, "t"), percent=percent)
    assert sorted(map(tuple, found.collect()), key=repr) == plain_resampling(ROWS, ["one two W5 w6 w7", None], percent)


def test_resampling_of_the_smallest_table(spark):
    docs = [(r.doc_id, r.text) for r in small(spark).collect()]
    want = plain_resampling(docs, [r.text for r in small(spark, "benchmark").collect()])
    got = resampling.op11_resampling(spark, SMALL)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((r[0], *r[2:]) for r in want), key=repr)


def test_resampling_of_empty_tables(spark):
    empty = table(spark, ROWS).where("false")
    target = empty.select("doc_id", "text")
    assert resampling.resample(empty, target, Workspace(spark, "t")).collect() == []
    found = resampling.resample(table(spark, ROWS), target, Workspace(spark, "t"))
    assert sorted(map(tuple, found.collect()), key=repr) == plain_resampling(ROWS, [])


@pytest.mark.parametrize("size", [1, 2, 7, 1000])
@pytest.mark.parametrize("n", [1, 2, 3])
def test_chunks_own_every_feature_once(size, n):
    text = "the cat  sat-on the mat. " * 5 + "end"
    words = text.replace("-", " ").replace(".", " ").split()
    want = Counter(zlib.crc32(" ".join(words[i : i + k]).encode()) % 977 for k in range(1, n + 1) for i in range(len(words) - k + 1))
    chunks = list(resampling.cut(text, n, size))
    assert sum(own for _, own in chunks) == len(words)
    found = resampling.bucketed([c for c, _ in chunks], [o for _, o in chunks], resampling.Features(n, 977))[1]
    assert Counter(found.tolist()) == want


def test_crc_of_long_words():
    words = [b"a" * k for k in (1, 63, 64, 65, 200)] + ["你".encode() * 40]
    found = resampling.bucketed([b" ".join(words)], [len(words)], resampling.Features(2, 1 << 31))[1]
    pairs = [a + b" " + b for a, b in zip(words, words[1:])]
    assert found.tolist() == [zlib.crc32(x) % (1 << 31) for x in words + pairs]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def plain_store(rows):
    tok, start, out = library(), 0, []
    coded = [(i, tok.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in rows]
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    for i, ids in sorted(coded, key=lambda x: (x[0] is None, x[0] or 0, len(x[1]), crc(x[1]))):
        out.append((i, start, len(ids), crc(ids), ids))
        start += len(ids)
    return out


def test_store_equals_the_library(spark):
    docs = [(r.doc_id, r.text) for r in small(spark).collect()]
    got = token_store.op12_token_store(spark, SMALL)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect())) == sorted(x[:4] for x in plain_store(docs))


def test_store_of_awkward_rows_and_lookup(spark):
    store = token_store.write_tokens(table(spark, ROWS), Workspace(spark, "t"), end_id=2)
    want = plain_store(ROWS)
    got = [tuple(r) for r in store.read().collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sorted(map(tuple, store.lookup([5, 8]).collect()), key=repr) == sorted((x for x in want if x[0] in (5, 8)), key=repr)
    assert store.ws.load("dictionary").count() == 1


def test_empty_store(spark):
    store = token_store.write_tokens(table(spark, ROWS).where("false"), Workspace(spark, "t"), end_id=2)
    assert store.read().collect() == []


def test_store_refuses_damage(spark):
    ws = Workspace(spark, "t")
    store = token_store.write_tokens(small(spark), ws, end_id=2)
    own = ws.load("blocks")
    for change in ({"digest": F.lit("0" * 64)}, {"crcs": F.transform("crcs", lambda x: x + 1)}):
        other = Workspace(spark, "t")
        for name in ("dictionary", "shards"):
            other.save(ws.load(name), name)
        other.save(own.withColumns(change), "blocks")
        with pytest.raises(Exception, match="dictionary|damaged"):
            token_store.TokenStore(other).read().collect()
    assert store.read().count() == small(spark).count()


def test_shared_dictionary_shortens_frames(spark):
    import zstandard

    store = token_store.write_tokens(small(spark), Workspace(spark, "t"), end_id=2)
    with_it = store.ws.load("blocks").agg(F.sum(F.octet_length("frames"))).first()[0]
    alone = sum(len(zstandard.ZstdCompressor(level=3).compress(np.array(r.ids, "<u2").tobytes())) for r in store.read().collect())
    assert with_it < alone


def test_pieces_of_every_code_point():
    """The cut of pieces against the library, each code point between letters, digits, marks and spaces."""
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        encoder = token_store.LibraryEncoder(f.read())
    points = [c for c in range(0x3400) if not 0xD800 <= c < 0xE000] + random.Random(1).sample(range(0xE000, 0x110000), 4000)
    texts = [f"a{chr(c)}b 1{chr(c)}2 .{chr(c)} {chr(c)}\n{chr(c)} {chr(c)}{chr(c)}  x it's" for c in points]
    want = encoder.library.encode_batch(texts, add_special_tokens=False)
    assert [encoder.encode(t) for t in texts] == [np.array(w.ids, "<u2").tobytes() for w in want]


def plain_mining(rows, every=50):
    rows = {i: (label, np.floor(256 * np.array(e, float)).astype(np.int64)) for i, label, e in sorted(rows, key=lambda r: -r[1])}
    ids = np.array(sorted(rows))
    width = max(len(rows[i][1]) for i in ids)
    label, e = np.array([rows[i][0] for i in ids]), np.array([np.pad(rows[i][1], (0, width - len(rows[i][1]))) for i in ids])
    out = []
    for a in np.flatnonzero(ids % every == 0):
        score = e @ e[a]
        order = np.lexsort((ids, -score))
        order = order[order != a]
        for p in order[label[order] == label[a]][:5]:
            fit = order[(label[order] != label[a]) & (50 * score[p] <= 100 * score[order]) & (100 * score[order] <= 95 * score[p])]
            out += [(int(ids[a]), int(ids[p]), k + 1, int(ids[n]), int(score[p]), int(score[n])) for k, n in enumerate(fit[:3])]
    return sorted(out)


VECTORS = "vec_id long, label int, embedding array<float>, score int, pivot string"


def mined(spark, rows, every):
    frame = spark.createDataFrame([(*r, 0, "p") for r in rows], VECTORS)
    return hard_negatives.mine(frame, Workspace(spark, "t"), anchor=F.col("vec_id") % every == 0)


def test_hard_negatives_of_awkward_rows(spark):
    """Ties, equal vectors, zeros, negative scores, shorter vectors, and rows that take no part."""
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(0, 3)), [float(x) for x in rng.integers(-2, 3, 4 - i % 2) / 8]) for i in range(150)]
    rows += [(1000 + i, i % 2, [0.25, 0.25, 0.0, 0.0]) for i in range(60)] + [(2000, 7, [0.5] * 4), (2005, 0, [0.0] * 4)]
    out = [(10, None, [1.0] * 4), (None, 1, [1.0] * 4), (3000, 1, None), (3005, 1, [1.0, None]), (3010, 1, [float("nan")]), (3015, 1, [float("inf")]), (3020, 1, [3e38, 1.0])]
    found = mined(spark, rows + out + rows[:3], 5)
    assert sorted(map(tuple, found.rows.collect())) == plain_mining(rows, 5)


def test_hard_negatives_prune_clusters(spark):
    """Vectors in tight clusters: the same rows from a part of the pairs."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(24, 8))
    rows = [(i, i % 3, [float(x) for x in centres[i % 24] + rng.normal(size=8) / 50]) for i in range(2400)]
    found = mined(spark, rows, 8)
    assert sorted(map(tuple, found.rows.collect())) == plain_mining(rows, 8)
    assert max(found.shares().values()) < 0.7


def test_hard_negatives_of_the_smallest_table(spark):
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in small(spark, "embeddings").collect()]
    assert sorted(map(tuple, hard_negatives.op13_hard_negatives(spark, SMALL).collect())) == plain_mining(rows)


def test_hard_negatives_of_empty_tables(spark):
    assert mined(spark, [], 5).rows.collect() == []
    assert mined(spark, [(1, 1, [1.0]), (2, 2, [1.0])], 5).rows.collect() == []
