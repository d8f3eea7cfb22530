"""``hk2`` keys: several tables of sign bits per embedding; near embeddings collide in some table.

Keys are BIGINT bit patterns of up to 64 bits, bit j of table t being the sign
of one signed sum.  Sums are taken in input order in double precision, so keys
are the same bits for any partitioning.  Given ``width``, embeddings of another
one are errors; without, each is keyed by its own, as if zeros followed it.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from orbweave import errors
from orbweave.functions.markers import ERRORS, SEED, splitmix64
from orbweave.functions.unsigned import as_col, from_hex16, hex16
from orbweave.functions.vectors import lists, matrix

ROWS = 1024
MOST_PROBES = 256


@dataclass(frozen=True)
class Tables:
    tables: int = 16
    bits: int = 8
    seed: int = SEED

    def __post_init__(self):
        if not 1 <= self.tables <= 1024:
            raise errors.TablesOutOfRange(str(self.tables))
        if not 1 <= self.bits <= 64:
            raise errors.BitsOutOfRange(str(self.bits))

    @property
    def digits(self) -> int:
        return -(-self.bits // 4)


@lru_cache(maxsize=4)
def _signs(width: int, space: Tables) -> np.ndarray:
    """[width, tables * bits] of +1 and -1."""
    seeds = splitmix64(space.seed, np.arange(space.tables))
    drawn = np.stack([splitmix64(int(s), np.arange(width)) for s in seeds], 1)
    turned = drawn[:, :, None] >> np.arange(space.bits, dtype=np.uint64) & np.uint64(1)
    return np.where(turned, -1.0, 1.0).reshape(width, space.tables * space.bits)


def margins_of(e: np.ndarray, space: Tables) -> np.ndarray:
    signs, sums = _signs(e.shape[1], space), np.zeros((len(e), space.tables * space.bits))
    values = e.astype(np.float64)
    with np.errstate(invalid="ignore", over="ignore"):
        for i in range(e.shape[1]):
            sums += values[:, i : i + 1] * signs[i]
    return sums.reshape(-1, space.tables, space.bits)


def keys_of(margins: np.ndarray) -> np.ndarray:
    weights = np.uint64(1) << np.arange(margins.shape[2], dtype=np.uint64)
    return ((margins > 0) * weights).sum(axis=2, dtype=np.uint64)


def _codes(e: np.ndarray, absent: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """Error code of each row, as in ``markers.ERRORS``."""
    code = np.where(~np.isfinite(e).all(axis=1), 2, np.where((e == 0).all(axis=1), 1, 0))
    code[odd], code[absent] = 3, 0
    return code


def key_error(e, *, width: int | None = None) -> Column:
    """Name of the error of an embedding that has no keys, null if it has some."""

    @F.arrow_udf("string")
    def error_name(x):
        import pyarrow as pa

        return pa.array([ERRORS[c].__name__ if c else None for c in _codes(*matrix(x, width)).tolist()], pa.string())

    return error_name(as_col(e).cast("array<float>"))


def _column(kind: str, space: Tables, finish, invalid: str, width: int | None):
    @F.arrow_udf(kind)
    def hash_embedding(array):
        import pyarrow as pa

        e, absent, odd = matrix(array, width)
        code = _codes(e, absent, odd)
        if invalid == "raise" and code.any():
            raise ERRORS[int(code[code > 0][0])]()
        found = [margins_of(e[at : at + ROWS], space) for at in range(0, len(e), ROWS)] or [np.zeros((0, space.tables, space.bits))]
        return finish(pa, np.concatenate(found), absent | (code > 0))

    return hash_embedding


def keys(e, space: Tables = Tables(), *, invalid: str = "raise", width: int | None = None) -> Column:
    """ARRAY<BIGINT> of one key per table."""
    return _column("array<long>", space, lambda pa, m, none: lists(keys_of(m).view(np.int64), pa.int64(), none), invalid, width)(as_col(e).cast("array<float>"))


def margins(e, space: Tables = Tables(), *, invalid: str = "raise", width: int | None = None) -> Column:
    """ARRAY<ARRAY<DOUBLE>> of the sums behind the bits."""

    def finish(pa, m, none):
        inner = lists(m.reshape(-1, space.bits), pa.float64())
        ends = pa.array(np.arange(len(m) + 1, dtype=np.int32) * space.tables)
        return pa.ListArray.from_arrays(ends, inner, mask=pa.array(none))

    return _column("array<array<double>>", space, finish, invalid, width)(as_col(e).cast("array<float>"))


def marker(keys_col, space: Tables = Tables()) -> Column:
    """Text form of a key array: ``hk2:tables:bits:seed:key.key...``."""
    parts = F.array_join(F.transform(as_col(keys_col), lambda k: F.substr(hex16(k), F.lit(17 - space.digits), F.lit(space.digits))), ".")
    return F.concat(F.lit(f"hk2:{space.tables}:{space.bits}:{space.seed:016x}:"), parts)


def parse(text) -> Column:
    """STRUCT<tables, bits, seed, keys> of canonical text; null for any other."""
    text = as_col(text)
    field = lambda i: F.split(text, ":")[i]
    shaped = F.coalesce(text.rlike(r"\Ahk2:[1-9][0-9]{0,3}:[1-9][0-9]?:[0-9a-f]{16}:[0-9a-f]{1,16}(\.[0-9a-f]{1,16})*\z"), F.lit(False))
    tables, bits, parts = field(1).cast("int"), field(2).cast("int"), F.split(field(4), r"\.")
    digits = F.ceil(bits / 4)
    most = F.pow(F.lit(2), 4 - F.pmod(-bits, F.lit(4)))
    sized = F.forall(parts, lambda k: (F.length(k) == digits) & (F.conv(F.substring(k, 1, 1), 16, 10).cast("int") < most))
    fits = (tables <= 1024) & (bits <= 64) & (F.size(parts) == tables) & sized
    found = F.struct(tables.alias("tables"), bits.alias("bits"), field(3).alias("seed"), F.transform(parts, from_hex16).alias("keys"))
    return F.when(shaped, F.when(fits, found))


def _best_flips(weights: np.ndarray, n: int) -> list[int]:
    """Masks over sorted weights, in order of their sum: the query-directed sequence of probes."""
    open_, out = [(0.0, 0)], []
    while open_ and len(out) < n:
        score, mask = heapq.heappop(open_)
        out.append(mask)
        last = mask.bit_length() - 1
        if last + 1 < len(weights):
            heapq.heappush(open_, (score + weights[last + 1], mask | 1 << last + 1))
            if last >= 0:
                heapq.heappush(open_, (score - weights[last] + weights[last + 1], mask ^ 1 << last | 1 << last + 1))
    return out


def probe_keys(margin_rows: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """[tables, n or fewer] keys nearest to a row's own, by the margins of the bits that differ."""
    out = []
    weights = np.where(np.isnan(margin_rows), np.inf, np.abs(margin_rows))
    for w, k in zip(weights, key.tolist()):
        order = np.argsort(w, kind="stable")
        flips = _best_flips(w[order], n)
        out.append([k ^ sum(1 << int(order[b]) for b in range(len(order)) if f >> b & 1) for f in flips])
    return np.array(out, np.uint64)


def probes(e, n: int, space: Tables = Tables(), *, invalid: str = "raise", width: int | None = None) -> Column:
    """ARRAY<ARRAY<BIGINT>>: per table the ``n`` keys to look up, from 1 to MOST_PROBES, the own one first."""
    if not 1 <= n <= MOST_PROBES:
        raise errors.OutputLengthMismatch(str(n))

    def finish(pa, m, none):
        own = keys_of(m)
        rows = [None if bad else probe_keys(m[i], own[i], n).view(np.int64).tolist() for i, bad in enumerate(none.tolist())]
        return pa.array(rows, pa.list_(pa.list_(pa.int64())))

    return _column("array<array<long>>", space, finish, invalid, width)(as_col(e).cast("array<float>"))
