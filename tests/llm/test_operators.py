"""Each operator against brute force, the reference library or an exact round trip, on the smallest tables and on awkward rows."""

import hashlib
import math
import random
import string
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from orbweave.llm import bpe, chat_tree, decontam, fuzzy_lines, html_diff, line_quality, ppm, queries, simhash_index, suffix_dedup, warc
from orbweave.llm.common import Workspace
from tests.conftest import SMALL

ROWS = [(1, "a b c"), (2, None), (3, ""), (4, "  \n\t "), (5, "a b c"), (5, "a b c"), (None, "x " * 3000), (7, "naïve café 你好 \U0001f600 <|endoftext|> it's")]


def docs(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, "s", 7) for i, t in rows], "doc_id long, text string, source string, Fp int")


def texts(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    frame, found = queries.QUERIES[name](spark, SMALL), con.execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in frame.collect()))) == sorted(map(repr, found.fetchall()))


def test_warc_round_trip(spark):
    page = "<p>" + "long " * 40
    rows = spark.createDataFrame([(1, "http://a/1", page), (2, "http://a/2", page), (2, "http://a/2", page), (3, None, None), (None, "u", "é")], "page_id long, url string, html string")
    archive = warc.write_archive(rows, Workspace(spark, "t"))
    got = sorted(((r.id, r.record_type, r.refers_to, bytes(r.payload).decode()) for r in archive.originals().collect()), key=repr)
    assert got == sorted([(1, "response", None, page), (2, "revisit", "1", page), (2, "revisit", "1", page), (3, "response", None, ""), (None, "response", None, "é")], key=repr)
    assert all(bytes(r.record).endswith(bytes(r.payload)) for r in archive.originals().collect())


def test_warc_headers_end_at_line_feeds_alone(spark):
    """A URL that holds a line separator and a forged header is no header."""
    forged = [f"http://a/{end}WARC-Refers-To: <urn:record:99>" for end in "\u2028\u2029\x85\n\r"]
    rows = spark.createDataFrame([(i, u, "p" * 200 + str(i)) for i, u in enumerate(forged)], "page_id long, url string, html string")
    got = warc.write_archive(rows, Workspace(spark, "t")).originals().collect()
    assert [(r.record_type, r.refers_to) for r in got] == [("response", None)] * len(forged)


def components(fps, radius=3):
    ids, root = sorted(set(fps)), {}
    root = {f: f for f in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    return {f: find(f) for f in ids}


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("rows", ["awkward", "table"])
def test_simhash_components(spark, rows):
    rows = ROWS if rows == "awkward" else texts(spark)
    got = simhash_index.near_duplicates(docs(spark, rows), Workspace(spark, "t")).collect()
    fps = [plain_fingerprint(t) for _, t in rows]
    root = components(fps)
    least = {}
    for (i, _), f in zip(rows, fps):
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    want = [(i, f, least.get(root[f])) for (i, _), f in zip(rows, fps)]
    assert sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got), key=repr) == sorted(want, key=repr)


def plain_ppm(rows):
    """Symbol by symbol, with the whole trie at hand."""
    counts = defaultdict(Counter)
    strings = lambda t: (lambda s: [(s[i - ppm.ORDER : i], s[i]) for i in range(ppm.ORDER, len(s))])(ppm.END * ppm.ORDER + ppm.normal_text(t) + ppm.END)
    import zlib

    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in rows]
    for (_, t), h in zip(rows, held):
        if not h:
            for context, symbol in strings(t):
                for k in range(ppm.ORDER + 1):
                    counts[context[ppm.ORDER - k :]][symbol] += 1
    out = []
    for _, t in rows:
        total = 0.0
        for context, symbol in strings(t):
            excluded, left = set(), True
            for k in range(ppm.ORDER, -1, -1):
                seen = {s: n for s, n in counts[context[ppm.ORDER - k :]].items() if s not in excluded}
                if seen:
                    all_ = sum(seen.values()) + len(seen)
                    if symbol in seen:
                        total += math.log10(seen[symbol] / all_)
                        left = False
                        break
                    total += math.log10(len(seen) / all_)
                excluded |= set(seen)
            if left:
                total -= math.log10(max(256 - len(excluded), 1))
        out.append(total)
    return held, out


def test_ppm_against_symbol_by_symbol(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["the", "cat", "Sat", "on", "mat", "zebra"]) for _ in range(rng.randrange(30)))) for i in range(60)] + ROWS[1:4]
    got = {(r.doc_id, r.n_tokens): r for r in ppm.score_documents(docs(spark, rows), Workspace(spark, "t")).collect()}
    held, scores = plain_ppm(rows)
    train = Counter(w for (_, t), h in zip(rows, held) if not h for w in [*ppm.normal_text(t).split(), None])
    n, v = sum(train.values()), len(train)
    for (i, t), h, score in zip(rows, held, scores):
        words = [*ppm.normal_text(t).split(), None]
        r = got[i, len(words)]
        base = sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        assert r.bits_per_byte == pytest.approx(-score / math.log10(2) / (len(ppm.normal_text(t)) + 1), abs=1e-9)
        assert (r.held_out, r.train_tokens, r.n_known) == (h, n, sum(train[w] > 0 for w in words))
        assert r.score == pytest.approx(score, abs=1e-6) and r.base_score == pytest.approx(base, abs=1e-6)


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    rows = ROWS + texts(spark)
    want = []
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    got = bpe.encode_documents(docs(spark, rows), keep=["doc_id", "Fp"]).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got), key=repr) == sorted(want, key=repr)


def plain_counts(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often, hit, seen, dup = Counter(windows), set(), set(), 0
    for i, w in enumerate(windows):
        if often[w] > 1:
            hit |= set(range(i, i + 8))
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


def test_quality_counts_and_verdicts(spark):
    rows = ROWS + texts(spark)
    got = line_quality.measure(docs(spark, rows), Workspace(spark, "t"))[0].collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted((repr(r.doc_id), *(r[c] for c in names)) for r in got) == sorted((repr(i), *plain_counts(t)) for i, t in rows)
    assert not any(r.kept and r.base_failed for r in got)
    body = lambda i: " ".join(f"w{i}x{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + i)}" for k in range(40))
    rows = [(i, f"Read our cookie policy here today\n{body(i)}") for i in range(12)] + [(99, "\n".join(["Read our cookie policy here today"] * 2))]
    kept = {r.doc_id: r.text for r in line_quality.clean(docs(spark, rows), Workspace(spark, "t")).collect()}
    assert kept == {i: body(i) for i in range(12)}


def test_decontamination(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    item = [word() for _ in range(40)]
    near = list(item)
    near[20] = "changed"
    pad = lambda: " ".join(word() for _ in range(60))
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, ""), (4, "two words")], "item_id long, text string")
    rows = [(1, f"{pad()} {' '.join(item).upper()}, {pad()}"), (2, f"{pad()} {' '.join(near)} {pad()}"), (3, pad()), (4, None), (5, " ".join(item[:20])), (6, "")]
    hits = {(r.doc_id, r.item_id) for r in decontam.contamination(docs(spark, rows), bench, similarity=0.7).collect()}
    assert hits == {(1, 1), (2, 1)}
    assert {r.doc_id for r in decontam.decontaminate(docs(spark, rows), bench, similarity=0.7).collect()} == {3, 4, 5, 6}
    assert {r.doc_id for r in decontam.contamination(docs(spark, rows), bench).collect()} == {1}
    assert decontam.contamination(docs(spark, rows), bench, similarity=0.7, block_words=10).count() == 2


def test_fuzzy_lines(spark):
    line = " ".join(f"word{chr(97 + i)}" for i in range(24))
    close = line.replace("wordc", "wordz")
    rows = [(1, f"{line}\nshort\n---"), (2, f"own text of the second document stays here in full\n{line.upper()}"), (3, close + "\n---"), (4, None), (5, ""), (6, "short")]
    got = {r.doc_id: r.text for r in fuzzy_lines.dedup_lines(docs(spark, rows), Workspace(spark, "t")).collect()}
    assert got[1] == f"{line}\nshort\n---" and got[2] == "own text of the second document stays here in full"
    assert got[4] is None and got[5] == "" and got[6] == ""
    hashes = np.random.default_rng(3).integers(0, 2**63, 200_000, dtype=np.uint64)
    who = np.sort(np.concatenate([np.zeros(70_000, int), np.random.default_rng(4).integers(0, 9, 130_000)]))
    fps, tells = fuzzy_lines.fingerprints(who, hashes, 11)
    for k in range(11):
        own = hashes[who == k]
        assert int(fps[k]) % (1 << 64) == sum(1 << b for b in range(64) if 2 * int((own >> np.uint64(b) & np.uint64(1)).sum()) > len(own)) and bool(tells[k]) == (k < 9)


def test_reply_trees(spark):
    rows = [("t", 1, None, "user", "hi </turn> \\# <b>", 0.0), ("t", 2, 1, "assistant", "### x: y", 2.0), ("t", 3, 1, "assistant", None, 1.0), ("t", 4, 2, "us:er", "more", 1.0), ("u", 1, 9, "user", "orphan", None), ("v", 1, 2, "a", "loop", 0.0), ("v", 2, 1, "a", "loop", 0.0)]
    chats = chat_tree.format_trees(spark.createDataFrame(rows, "tree string, id long, parent long, role string, text string, score double"), Workspace(spark, "t"))
    got = {(r.tree, r.leaf): (r.branch_rank, [(t.role, t.text) for t in r.turns]) for r in chats.withColumn("turns", chat_tree.read_turns(F.col("formatted"))).collect()}
    first = ("user", "hi </turn> \\# <b>")
    assert got == {("t", 4): (1, [first, ("assistant", "### x: y"), ("us:er", "more")]), ("t", 3): (2, [first, ("assistant", "")]), ("u", 1): (1, [("user", "orphan")])}


def plain_removal(rows, n):
    """Every string of ``n`` bytes, counted."""
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[i : i + n] for d in data for i in range(len(d) - n + 1))
    want = []
    for (i, _), d in zip(rows, data):
        gone = [False] * len(d)
        for k in range(len(d) - n + 1):
            if seen[d[k : k + n]] > 1:
                gone[k : k + n] = [True] * n
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        want.append((i, len(d), sum(gone), runs, sha(bytes(b for b, g in zip(d, gone) if not g))))
    return want


def test_suffix_removal_of_the_smallest_table(spark):
    rows = texts(spark)
    got = suffix_dedup.remove_repeats(docs(spark, rows), Workspace(spark, "t"), batches=3).collect()
    want = plain_removal(rows, suffix_dedup.LENGTH)
    assert sorted(tuple(r)[:5] for r in got) == sorted(want) and sum(w[2] for w in want) > 0


def test_shared_passages(spark):
    """Texts that share more than 50 words, however spaced, are told; those that share 23, and whole copies, are not."""
    rng = random.Random(6)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage, short, twice = words(51), words(23), " ".join(words(300))
    rows = [(1, " ".join(words(40) + passage + words(70))), (2, " ".join(words(90)) + "\n" + "\n ".join(passage)), (3, " ".join(words(60) + short + words(60))), (4, " ".join(short + words(100)))]
    rows += [(5, twice), (6, twice), (7, None), (8, " ".join(passage[:20])), (9, " ".join(passage + words(80) + passage))]
    got = {r.doc_id: r.n_passages for r in suffix_dedup.remove_repeats(docs(spark, rows), Workspace(spark, "t")).collect()}
    assert got == {1: 1, 2: 1, 3: 0, 4: 0, 5: 0, 6: 0, 7: 0, 8: 0, 9: 2}


def test_suffix_removal_against_every_string(spark):
    rng = random.Random(4)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, other = noise(700), noise(401)
    rows = [(1, noise(300) + passage + noise(50)), (2, passage[100:650]), (3, other + "é" + other[:400]), (4, other[1:] + noise(9)), (5, "z" * 1000), (6, None), (7, ""), (8, noise(900)), (9, "same " * 90), (9, "same " * 90), (10, passage[:399])]
    for batches in (1, 4):
        got = suffix_dedup.remove_repeats(docs(spark, rows), Workspace(spark, "t"), batches=batches).collect()
        assert sorted(tuple(r)[:5] for r in got) == sorted(plain_removal(rows, suffix_dedup.LENGTH))


def test_html_extraction(spark):
    rows = [(1, "http://h/b/1", "<html><head><title>T</title></head><body><nav>Menu</nav><article><h1>Head&amp;line</h1><p>Some\n  <b>bold</b> text.</p></article><div class='comments'>no</div><script>x()</script><footer>F</footer></body></html>"), (2, "http://h/a/2", "<div>Site slogan</div><p>First story.</p>"), (3, "http://h/a/3", "<div>Site slogan</div><p>Second story.</p>"), (4, None, None), (5, "http://g/", "<p>Alone &lt;3")]
    got = {r.page_id: (r.text, r.n_chars) for r in html_diff.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), Workspace(spark, "t")).collect()}
    assert got == {k: (t, len(t)) for k, t in {1: "Head&line Some bold text.", 2: "First story.", 3: "Second story.", 4: "", 5: "Alone <3"}.items()}


def plain_lcs(a, b):
    """Length table of common subsequences, and which lines of ``a`` some longest one can hold last, walked back as the operator does."""
    long = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            long[i][j] = long[i - 1][j - 1] + 1 if x == y else max(long[i - 1][j], long[i][j - 1])
    return long[-1][-1]


def test_shared_lines_is_a_longest_common_subsequence():
    rng = random.Random(14)
    for n in [0, 1, 2, 3, 5, 8, 20, 60] * 6:
        a, b = ([rng.randrange(1 + n // 2) for _ in range(rng.randrange(n + 1))] for _ in range(2))
        at = html_diff.shared_lines(a, b)
        rest = iter(b)
        assert at == sorted(set(at)) and all(any(a[i] == y for y in rest) for i in at) and len(at) == plain_lcs(a, b)


def test_differencing_against_brute_force(spark):
    """Forty pages without a declared article over five hosts: lines shared with the nearest URL go, by a plain table of common subsequences."""
    rng = random.Random(12)
    line = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(6))
    pages = []
    for h in range(5):
        frame = [line() for _ in range(6)]
        for k in range(8):
            own = [line() for _ in range(rng.randrange(1, 5))]
            lines = [x for x in frame if rng.random() < 0.8] + own + [x for x in frame[:2] if rng.random() < 0.3]
            pages.append((len(pages), f"http://h{h}.example/{rng.choice('ab')}/{rng.choice('cd')}{k}", lines))
    pages.append((len(pages), pages[3][1] + "/mirror", pages[3][2]))  # a mirror: no neighbour of its original
    want = {}
    for i, url, lines in pages:
        host, path = url[7:].split("/", 1)
        near = {}
        for _, u, other in pages:
            if u[7:].split("/", 1)[0] == host:
                body = tuple(other)
                near[body] = min("/" + u[7:].split("/", 1)[1], near.get(body, "~"))
        order = sorted((p, body) for body, p in near.items())
        at = next(k for k, (_, body) in enumerate(order) if body == tuple(lines))
        common = lambda p, q: next((k for k, (x, y) in enumerate(zip(p, q)) if x != y), min(len(p), len(q)))
        before, after = order[at - 1] if at else None, order[at + 1] if at + 1 < len(order) else None
        best = after if before is None or after and common(order[at][0], after[0]) > common(order[at][0], before[0]) else before
        want[i] = (len(lines) - plain_lcs(lines, list(best[1])), set(lines) - set(best[1]))
    rows = [(i, u, "<html><body>" + "".join(f"<div>{x}</div>" for x in lines) + "<footer>f</footer></body></html>") for i, u, lines in pages]
    found = {r.page_id: r.text for r in html_diff.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), Workspace(spark, "t")).collect()}
    for i, _, lines in pages:
        n, own = want[i]
        assert len(found[i].split()) == 6 * n and all(x in found[i] for x in own)
    assert found[len(pages) - 1] == found[3]


def test_lines_beside_an_article(spark):
    """Markup protects the article; beside it, what the nearest page shares goes and the rest stays."""
    page = lambda *own: "".join(f"<div>{x}</div>" for x in ("Shop slogan", own[0])) + f"<article><p>Quoted by both.</p><p>{own[1]}</p></article>"
    rows = [(1, "http://h/a/1", page("Part one", "First.")), (2, "http://h/a/2", page("Part two", "Second.")), (2, "http://h/a/2", page("Part two", "Second."))]
    got = sorted((r.page_id, r.text) for r in html_diff.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), Workspace(spark, "t")).collect())
    assert got == [(1, "Part one Quoted by both. First."), (2, "Part two Quoted by both. Second."), (2, "Part two Quoted by both. Second.")]


def test_decontamination_against_every_window(spark):
    """The whole smallest tables, and windows with words changed: all item-sized windows by exact similarity, without any fingerprint."""
    rng = random.Random(13)
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    words = lambda t: "".join(c for c in (t or "").lower() if c not in string.punctuation).split()
    rows = texts(spark)
    for k, (_, t) in enumerate(bench[:40]):
        own = words(t)
        for _ in range(k % 4):
            own[rng.randrange(len(own))] = "changed"
        rows.append((10_000 + k, " ".join([*words(rows[k][1])[:30], *own, *words(rows[k + 1][1])[:30]])))
    cut = lambda w: (min(5, len(w)), [tuple(w[i : i + min(5, len(w))]) for i in range(len(w) - min(5, len(w)) + 1)])
    want = set()
    items = [(i, len(words(t)), *cut(words(t))) for i, t in bench if words(t)]
    for doc, t in rows:
        own = words(t)
        grams = {size: [tuple(own[k : k + size]) for k in range(len(own) - size + 1)] for size in {x[2] for x in items}}
        have = {size: set(g) for size, g in grams.items()}
        for item, n, size, parts in items:
            if not have[size] & set(parts):
                continue
            wide = n - size + 1
            for s in range(max(0, len(grams[size]) - wide) + 1):
                window = Counter(grams[size][s : s + wide])
                common = sum((window & Counter(parts)).values())
                if common >= 0.8 * (sum(window.values()) + len(parts) - common):
                    want.add((doc, item))
                    break
    got = {(r.doc_id, r.item_id) for r in decontam.contamination(docs(spark, rows), spark.createDataFrame(bench, "item_id long, text string"), block_words=2000).collect()}
    assert got == want and len(want) >= 15


def test_empty_tables(spark):
    none = docs(spark, [])
    frames = [
        simhash_index.near_duplicates(none, Workspace(spark, "t")), ppm.score_documents(none, Workspace(spark, "t")), bpe.encode_documents(none, keep=["doc_id"]),
        line_quality.clean(none, Workspace(spark, "t")), fuzzy_lines.dedup_lines(none, Workspace(spark, "t")), suffix_dedup.remove_repeats(none, Workspace(spark, "t")),
        simhash_index.deduplicate(none, Workspace(spark, "t")), decontam.contamination(none, spark.createDataFrame([], "item_id long, text string")),
        html_diff.extract(spark.createDataFrame([], "page_id long, url string, html string"), Workspace(spark, "t")),
    ]
    assert [f.count() for f in frames] == [0] * len(frames)


def test_near_dedup_against_every_pair(spark):
    """Many candidates prove false here, closer ones than true links among them."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**6)}"
    rows = []
    for size in (40, 90):
        body = [word() for _ in range(size)]
        for _ in range(60):
            text = list(body)
            for _ in range(rng.randrange(1 + size // 25)):
                text[rng.randrange(size)] = word()
            rows.append((len(rows), " ".join(text)))
            body = text if rng.random() < 0.3 else body
    rng.shuffle(rows)
    for similarity in (0.8, 0.93):
        own = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
        root = {i: i for i in own}
        for a in sorted(own):
            for b in range(a):
                x, y = own[a], own[b]
                if len(x & y) >= similarity * len(x | y):
                    low, high = sorted((root[a], root[b]))
                    root = {i: low if r == high else r for i, r in root.items()}
        got = {r.doc_id for r in simhash_index.deduplicate(docs(spark, rows), Workspace(spark, "t"), similarity=similarity).collect()}
        assert got == set(root.values()) and 3 <= len(got) < len(rows)


def test_near_dedup_keeps_one_of_each_group(spark):
    rng = random.Random(8)
    body = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    near = [*body[:60], "other", *body[61:]]
    rows = [(3, " ".join(body)), (1, " ".join(near)), (2, " ".join(body)), (4, " ".join(f"v{rng.randrange(10**6)}" for _ in range(120))), (6, None), (5, "")]
    assert {r.doc_id for r in simhash_index.deduplicate(docs(spark, rows), Workspace(spark, "t")).collect()} == {1, 4, 5}


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_long_lines_are_compared_by_edits():
    """At any length: the same words in reverse are unlike, a few edits are like, and the threshold is exact."""
    words = [f"word{i * 7919 % 3001}" for i in range(3000)]
    line, back = " ".join(words), " ".join(words[::-1])
    assert len(line) > 20_000 and not fuzzy_lines.alike(line, back, 0.8)
    few = line[:9000] + "XYZ" + line[9400:]
    assert fuzzy_lines.alike(line, few, 0.8)
    n = len(line) // 5
    for edits, want in ((n, True), (n + 1, False)):
        assert fuzzy_lines.alike(line, "#" * edits + line[edits:], 0.8) is want


def line_recall(spark, groups):
    """Of all pairs of lines with edit similarity of 0.8, the share found in one group; and wrong groups' lines."""
    lines = sorted({x for group in groups for x in group})
    rows = [(i, x) for i, x in enumerate(lines)]
    _, repeated = fuzzy_lines.line_classes(docs(spark, rows), Workspace(spark, "t"))
    roots = {r.line: r.root for r in repeated.collect()}
    hashes = {r.text: r.h for r in docs(spark, rows).select("text", F.xxhash64("text").alias("h")).collect()}
    near, alone = [], set(lines)
    for i, a in enumerate(lines):
        for b in lines[:i]:
            most = int(max(len(a), len(b)) * 0.2 + 1e-9)
            if abs(len(a) - len(b)) <= most and edit_distance(a, b) <= most:
                near.append((a, b))
                alone -= {a, b}
    found = sum(hashes[a] in roots and roots[hashes[a]] == roots.get(hashes[b]) for a, b in near)
    return found, len(near), [x for x in alone if hashes[x] in roots]


def test_fuzzy_lines_against_every_pair(spark):
    """Lines of 8 to 40 words with a word replaced, added or left out, or with letters changed."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9)))
    groups = []
    for k in range(40):
        line = [word() for _ in range(rng.randrange(8, 41))]
        at = rng.randrange(len(line))
        change = [[word()], [line[at], word()], [], [line[at][::-1]]][k % 4]
        typed = "".join(rng.choice("xyz") if c != " " and rng.random() < 0.06 else c for c in " ".join(line))
        groups.append([" ".join(line), " ".join(line[:at] + change + line[at + 1 :]), typed])
    found, near, wrong = line_recall(spark, groups)
    assert near >= 80 and found >= 0.9 * near and not wrong


def test_near_dedup_recall_at_the_threshold(spark):
    """Block edits and appended passages at similarity 0.80 to 0.85, and a passage repeated in one copy; no radius in the brute force."""
    rng = random.Random(17)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shingles = lambda t: {tuple(t[k : k + 5]) for k in range(len(t) - 4)}
    pairs = []
    for k in range(90):
        body = words(rng.randrange(200, 300))
        if k % 3 == 0:
            copy = [*body[:60], *words(len(body) // 13), *body[60 + len(body) // 13 :]]
        elif k % 3 == 1:
            copy = body + words(len(body) * 21 // 100)
        else:
            copy = body + words(10) * 10
        alike = len(shingles(body) & shingles(copy)) / len(shingles(body) | shingles(copy))
        assert 0.8 <= alike < 0.85 or k % 3 == 2 and alike > 0.9
        pairs.append((body, copy))
    rows = [(2 * k + side, " ".join(t)) for k, pair in enumerate(pairs) for side, t in enumerate(pair)]
    kept = {r.doc_id for r in simhash_index.deduplicate(docs(spark, rows), Workspace(spark, "t")).collect()}
    assert all(2 * k in kept for k in range(90))
    found = [2 * k + 1 not in kept for k in range(90)]
    assert sum(found) >= 0.95 * len(found) and all(found[2::3])


def test_fuzzy_lines_of_few_words_against_every_pair(spark):
    """Short lines, 3 to 7 words, and unspaced lines with a letter replaced, added or left out."""
    rng = random.Random(22)
    letters = lambda n, of: "".join(rng.choice(of) for _ in range(n))
    groups = []
    for k in range(60):
        if k % 3 == 0:
            line = letters(rng.randrange(5, 15), "abcdefghij")
        elif k % 3 == 1:
            line = " ".join(letters(rng.randrange(4, 9), "abcdefghijklmn") for _ in range(rng.randrange(3, 8)))
        else:
            line = letters(rng.randrange(15, 80), [chr(0x4E00 + i) for i in range(200)])
        at = rng.randrange(1, len(line) - 1)
        at += line[at] == " "
        groups.append([line, line[:at] + ["x", "", "x" + line[at]][k // 3 % 3] + line[at + 1 :]])
    found, near, wrong = line_recall(spark, groups)
    assert near >= 60 and found >= 0.9 * near and not wrong


def test_lines_of_a_common_key_against_every_pair(spark):
    """All lines hold one passage, so they share keys with a commonest line that none is like: no planted near pair that shares a key is lost."""
    rng = random.Random(41)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    passage = " ".join(letters(6) for _ in range(12))
    lines = [f"{passage} {' '.join(letters(5) for _ in range(4))}"] * 3
    for _ in range(60):
        own = [letters(rng.randrange(3, 8)) for _ in range(18)]
        near = [letters(len(x)) if k % 4 == 1 else x for k, x in enumerate(own)]
        lines += [f"{passage} {' '.join(own)}", f"{passage} {' '.join(near)}"]
    rows = list(enumerate(lines))
    _, repeated = fuzzy_lines.line_classes(docs(spark, rows), Workspace(spark, "t"))
    roots = {r.line: r.root for r in repeated.collect()}
    *_, ids, _, _, _, keys, counts = fuzzy_lines.line_features(lines)
    keys, near, lost = [set(x) for x in np.split(keys, np.cumsum(counts)[:-1])], 0, 0
    for i in range(3, len(lines), 2):
        most = int(max(len(lines[i]), len(lines[i + 1])) * 0.2 + 1e-9)
        if keys[i] & keys[i + 1] and edit_distance(lines[i], lines[i + 1]) <= most:
            near += 1
            lost += roots.get(ids[i], ids[i]) != roots.get(ids[i + 1], ids[i + 1])
    assert near >= 55 and not lost


def test_lines_of_a_key_meet_in_chunks(spark, monkeypatch):
    """Keys of many lines are dealt to several groups; with groups of two lines the links are the same."""
    rng = random.Random(43)
    letters = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    lines = [letters(40) for _ in range(9)]
    lines += [x[:15] + "zz" + x[17:] for x in lines]
    *_, ids, _, _, _, _, _ = fuzzy_lines.line_features(lines)
    entries = spark.createDataFrame([(1, len(lines), int(i), len(x), int(i)) for i, x in zip(ids, lines)], "key long, n long, id long, size int, root long")
    rows = docs(spark, list(enumerate(lines)))
    for meet in (2, 5, 512):
        monkeypatch.setattr(fuzzy_lines, "MEET", meet)
        found = [frozenset((r.a, r.b)) for r in fuzzy_lines.settled(entries, rows, Workspace(spark, "t"), 0.8).collect()]
        assert sorted(map(sorted, found)) == sorted(sorted(map(int, (ids[k], ids[k + 9]))) for k in range(9))


def test_unlike_lines_are_told_for_sure():
    """The filter before the edit distance calls no near pair unlike, at any length and in any script."""
    rng = random.Random(44)
    lines, x, y = [], [], []
    for k in range(400):
        own = [rng.choice("abcdefg \u00e9\u5b57\U0001f600") for _ in range(rng.choice([1, 4, 20, 63, 64, 65, 130, 300]))]
        near = list(own)
        for _ in range(round(len(own) * rng.choice([0.1, 0.19, 0.2, 0.21, 0.9]))):
            at = rng.randrange(len(near))
            near[at : at + 1] = rng.choice([["z"], [], [near[at], "y"]]) if len(near) > 1 else ["z"]
        pair = sorted(("".join(own), "".join(near)), key=len)
        lines += pair
        x.append(2 * k)
        y.append(2 * k + 1)
    x, y = np.array(x), np.array(y)
    most = np.array([int(len(lines[j]) * 0.2 + 1e-9) for j in y])
    gone = fuzzy_lines.unlike(lines, x, y, most)
    near = np.array([edit_distance(lines[i], lines[j]) <= m for i, j, m in zip(x, y, most)])
    assert near.sum() >= 100 and gone.sum() >= 50 and not (gone & near).any()


def test_unlike_long_lines_are_told_for_sure():
    """Lines of 300 to 2,000 characters with blocks added and left out and letters changed, about the threshold: rows of the table outside the band are left out."""
    rng = random.Random(46)
    lines, near = [], []
    for _ in range(300):
        own = [rng.choice("abcdefghijklmnop \u00e9") for _ in range(rng.randrange(300, 2000))]
        other, left = list(own), int(len(own) * rng.choice([0.05, 0.12, 0.17, 0.19, 0.2, 0.4]))
        while left > 0:
            n, at = min(left, rng.choice([1, 1, 1, 7, 60])), rng.randrange(len(other) // rng.choice([1, 4]))
            other[at : at + rng.choice([0, n, n])] = [rng.choice("xyz") for _ in range(rng.choice([0, n, n]))]
            left -= n
        pair = sorted(("".join(own), "".join(other)), key=len)
        lines += pair
        near.append(fuzzy_lines.alike(*pair, 0.8))
    x, near = 2 * np.arange(len(near)), np.array(near)
    most = np.array([int(len(lines[k + 1]) * 0.2 + 1e-9) for k in x])
    gone = fuzzy_lines.unlike(lines, x, x + 1, most)
    assert near.sum() >= 100 and not (gone & near).any()
    many = [tuple(sorted((rng.randrange(len(lines)), rng.randrange(len(lines))), key=lambda k: len(lines[k]))) for _ in range(2000)]
    x, y = np.array(many).T
    gone = fuzzy_lines.unlike(lines, x, y, np.array([int(len(lines[k]) * 0.2 + 1e-9) for k in y]))
    other = (x // 2 != y // 2) & np.array([len(lines[i]) >= 0.8 * len(lines[j]) for i, j in many])
    assert gone[other].mean() > 0.95 and not gone[x == y].any()


def test_lines_are_sent_to_their_keys_as_codes(spark):
    """Lines of 2,000 characters that share forty keys: their shuffle files hold less than a fifth of what copies of the texts would take."""
    rng = random.Random(47)
    lines = ["".join(rng.choice("abcdefghijklmnop") for _ in range(2000)) for _ in range(30)]
    lines.append(lines[0][:700] + lines[0][900:])
    ids = fuzzy_lines.line_features(lines)[2].tolist()
    table = [(k, len(ids), i, len(x), i) for k in range(40) for i, x in zip(ids, lines)]
    entries = spark.createDataFrame(table, "key long, n long, id long, size int, root long")
    held = lambda: sum(p.stat().st_size for p in Path(spark.conf.get("spark.local.dir")).rglob("shuffle_*.data"))
    before = held()
    found = fuzzy_lines.settled(entries, docs(spark, list(enumerate(lines))), Workspace(spark, "t"), 0.8).collect()
    assert {frozenset((r.a, r.b)) for r in found} == {frozenset((ids[0], ids[-1]))}
    assert held() - before < 40 * sum(map(len, lines)) / 5


def test_near_dedup_of_distant_fingerprints(spark):
    """Texts of nine words and their first eight, similarity 0.8: those whose fingerprints are far apart are linked too."""
    rng = random.Random(45)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = []
    while len(texts) < 40:
        own = words(9)
        pair = [" ".join(own), " ".join(own[:8])]
        a, b = (simhash_index.shingle_set(t) for t in pair)
        if len(np.intersect1d(a, b)) == 4 and len(np.union1d(a, b)) == 5 and ((simhash_index.set_fingerprint(a) ^ simhash_index.set_fingerprint(b)) % (1 << 64)).bit_count() > 20:
            texts += pair
    kept = {r.doc_id for r in simhash_index.deduplicate(docs(spark, list(enumerate(texts))), Workspace(spark, "t")).collect()}
    assert kept == set(range(0, 40, 2))


def test_bounds_of_near_dedup_leave_out_no_near_pair(spark, tmp_path):
    """Two sets have no more in common than their class counts say; of pairs under common keys few are unlike, and none alike is missing."""
    from orbweave.llm.simhash_index import class_counts, first_shingles, most_common
    from orbweave.llm.stars import every_pair, unsettled

    rng = np.random.default_rng(9)
    draw = lambda n: rng.integers(0, 2**64, n, np.uint64, endpoint=False)
    sets = []
    for n in (0, 1, 5, 40, 700):
        one = np.unique(draw(n))
        sets.append(one)
        for gone in (1, n // 20, n // 9, n // 6, n // 4):
            sets.append(np.unique(np.concatenate([one[rng.permutation(len(one))[gone:]], draw(gone)])))
    common = lambda x, y: len(np.intersect1d(x, y))
    for x in sets:
        for y in sets:
            assert common(x, y) <= most_common(class_counts(x), class_counts(y))
    assert most_common(class_counts(draw(700)), class_counts(draw(900))) < 0.75 * 700
    assert most_common(np.full(16, 255, np.uint8), np.zeros(16, np.uint8)) > 10**9

    rows = [(i, len(x), first_shingles(x, 0.8).view(np.int64).tolist() if len(x) else [0]) for i, x in enumerate(sets)]
    items, roots = spark.createDataFrame(rows, "id long, size int, keys array<long>"), spark.createDataFrame([], "id long, root long")
    got = [frozenset(r) for r in every_pair(unsettled(items, roots, 0.8, placed=True), 0.8).collect()]
    alike = {frozenset((i, j)) for i, x in enumerate(sets) for j, y in enumerate(sets) if i < j and common(x, y) >= 0.8 * (len(x) + len(y) - common(x, y))}
    key_met = {frozenset((i, j)) for i, _, x in rows for j, _, y in rows if i < j and set(x) & set(y) and min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j]))}
    assert alike <= set(got) < key_met
