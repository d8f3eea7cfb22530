"""Exact byte-pair encoding by dynamic programming over prefixes, and decoding.

For each prefix of a piece there is at most one token with which its encoding
can end.  An automaton over the vocabulary (suffix links lead from each state
to the next shorter token that ends there) lists the tokens that end at each
byte; the one whose predecessor's last token is compatible with it is stored,
and back-pointers from the end give the ids.  Two adjacent tokens are
compatible if no merge would ever have crossed the border between them.

Pieces come from the tokenizer's own pattern; encodings of short pieces are
kept per Python worker.  The vocabulary file is read on the driver and
broadcast: its size is that of the file, whatever the corpus.

Defined results: null text encodes to no ids and decodes to the empty text; the
strings of special tokens in a text become their ids, as the tokenizers library
does; other columns pass through; repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from orbweave.llm.common import table

#: The pattern of the byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NEVER = 1 << 60
KEPT_PIECES, KEPT_LENGTH, KEPT_PAIRS = 200_000, 64, 400_000


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixBpe:
    """A byte-level BPE vocabulary, from the JSON of the tokenizers library."""

    def __init__(self, spec: bytes | str):
        import ahocorasick
        import regex

        data = json.loads(spec)
        letters = byte_letters()
        vocab, merges = data["model"]["vocab"], data["model"]["merges"]
        self.bytes = {i: bytes(letters[c] for c in t) for t, i in vocab.items()}
        special = {x["content"]: x["id"] for x in data["added_tokens"]}
        self.special = special
        self.bytes |= {i: t.encode() for t, i in special.items()}
        self.split = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.find = regex.compile(PATTERN).findall

        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.rank = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(pairs)}
        made = {vocab[a + b]: (vocab[a], vocab[b], r) for r, (a, b) in enumerate(pairs)}
        # From a token to its outermost byte: (part, rank of the merge that absorbs it).
        self.right: dict[int, list[tuple[int, int]]] = {}
        self.left: dict[int, list[tuple[int, int]]] = {}
        for token in vocab.values():
            for spine, side in ((self.right, 1), (self.left, 0)):
                parts, part = [(token, NEVER)], token
                while part in made:
                    parts.append((made[part][side], made[part][2]))
                    part = made[part][side]
                spine[token] = parts
        self.pairs: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for token in vocab.values():
            if token not in made or self._whole(*made[token]):
                self.automaton.add_word(self.bytes[token].decode("latin-1"), (token, len(self.bytes[token])))
        self.automaton.make_automaton()
        self.kept: dict[str, tuple[str, bytes]] = {}

    def _crossed(self, a: int, b: int, before: int) -> bool:
        """Whether a merge of rank under ``before`` joins the end of a to the start of b."""
        for x, x_until in self.right[a]:
            for y, y_until in self.left[b]:
                r = self.rank.get((x, y))
                if r is not None and r < before and r < x_until and r <= y_until:
                    return True
        return False

    def _whole(self, a: int, b: int, rank: int) -> bool:
        return not self._crossed(a, b, rank)

    def compatible(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = not self._crossed(a, b, NEVER)
        return known

    def piece_ids(self, piece: bytes) -> list[int]:
        n = len(piece)
        last: list[tuple[int, int] | None] = [None] * (n + 1)
        for end, found in self.automaton.iter(piece.decode("latin-1")):
            end += 1
            if last[end] is None:
                start = end - found[1]
                if not start or (before := last[start]) is not None and self.compatible(before[0], found[0]):
                    last[end] = found
        ids = []
        while n:
            token, size = last[n]
            ids.append(token)
            n -= size
        return ids[::-1]

    def _piece(self, piece: str) -> tuple[str, bytes]:
        """Ids, joined by commas, and what they decode to."""
        ids = self.piece_ids(piece.encode("utf-8"))
        found = ",".join(map(str, ids)), b"".join([self.bytes[i] for i in ids])
        if len(piece) <= KEPT_LENGTH:
            if len(self.kept) >= KEPT_PIECES:
                self.kept.clear()
            self.kept[piece] = found
        return found

    def encode(self, text: str) -> list[tuple[str, bytes]]:
        """The pieces of a text, each as joined ids and bytes."""
        out: list[tuple[str, bytes]] = []
        at = 0
        for m in self.split.finditer(text) if self.split else ():
            out += self._plain(text[at : m.start()])
            out.append((str(self.special[m[0]]), m[0].encode()))
            at = m.end()
        return out + self._plain(text[at:] if at else text)

    def _plain(self, text: str) -> list[tuple[str, bytes]]:
        get, make = self.kept.get, self._piece
        return [get(p) or make(p) for p in self.find(text)]

    def ids(self, text: str) -> list[int]:
        return [int(i) for piece, _ in self.encode(text) for i in piece.split(",")]

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.bytes.get(i, b"") for i in ids).decode("utf-8", "replace")


_MODELS: dict[str, PrefixBpe] = {}


def _model(spec: bytes) -> PrefixBpe:
    """One model per Python worker and vocabulary."""
    key = hashlib.sha256(spec).hexdigest()
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = PrefixBpe(spec)
    return _MODELS[key]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_documents(docs: DataFrame, *, text_col: str = "text", keep: list[str], tokenizer_path: str | None = None, with_ids: bool = True) -> DataFrame:
    """``keep`` columns, then ``n_tokens, ids_sha256, decoded_sha256`` and, on request, ``token_ids``.

    No shuffle; a task holds one Arrow batch and the vocabulary.  Columns to keep
    that have one of these names, in any case, give way to the new ones.
    """
    new = {"n_tokens", "ids_sha256", "decoded_sha256"} | ({"token_ids"} if with_ids else set())
    keep = [c for c in keep if c.lower() not in new]
    spark = docs.sparkSession
    with open(tokenizer_path or default_path(), "rb") as f:
        spec = spark.sparkContext.broadcast(f.read())
    kinds = {x.name: x.dataType.simpleString() for x in docs.schema}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + ["n_tokens long, ids_sha256 string, decoded_sha256 string"] + ["token_ids array<int>"] * with_ids)
    n_keep = len(keep)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        bpe = _model(spec.value)
        for batch in batches:
            counts, digests, decoded, ids, ends = [], [], [], [], [0]
            for text in batch.column(n_keep):
                pieces = bpe.encode(text.as_py() or "")
                joined = ",".join([p[0] for p in pieces])
                counts.append(joined.count(",") + 1 if joined else 0)
                digests.append(hashlib.sha256(joined.encode()).hexdigest())
                decoded.append(hashlib.sha256(b"".join([p[1] for p in pieces]).decode("utf-8", "replace").encode("utf-8")).hexdigest())
                if with_ids:
                    ids.append(np.array(joined.split(","), np.int32) if joined else np.empty(0, np.int32))
                    ends.append(ends[-1] + counts[-1])
            arrays = [batch.column(i) for i in range(n_keep)] + [pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            if with_ids:
                arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32), pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, [*keep, "n_tokens", "ids_sha256", "decoded_sha256"] + ["token_ids"] * with_ids)

    return docs.select(*[docs[c] for c in keep], docs[text_col].cast("string").alias("_text")).mapInArrow(run, schema)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), keep=["doc_id"], with_ids=False)
