"""``hk1`` markers: embeddings as sortable text keys whose prefixes name neighbourhoods.

An embedding is projected on ``dims`` axes by signs drawn from a seed, squashed
to ``bits`` bits per axis and indexed along the n-dimensional curve.  Results
are the same bits for any partitioning: sums have a fixed order, and the
exponential is a fixed polynomial.  Keys are fixed-width hex of
``ceil(dims * bits / 4)`` digits, so string order is key order.

Given ``width``, embeddings of another one are errors; without, each embedding
is keyed by its own, as if zeros followed it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from orbweave import errors
from orbweave.functions.curve import check_space, decode_array, encode_array
from orbweave.functions.unsigned import as_col
from orbweave.functions.vectors import from_hex, hex_text, lists, matrix

SEED = 0x9E3779B97F4A7C15
MOST_INPUTS = 65536
ROWS, TILE = 2048, 128
#: Divisors of the exponential's polynomial, from the highest power.
FACTORIALS = (39916800, 3628800, 362880, 40320, 5040, 720, 120, 24, 6, 2, 1, 1)
ERRORS = {1: errors.ZeroVector, 2: errors.NonFiniteValue, 3: errors.DimensionMismatch}


def splitmix64(seed: int, i: np.ndarray) -> np.ndarray:
    """The i-th outputs of the generator, modulo 2**64."""
    u = np.uint64
    z = u(seed) + (i.astype(u) + u(1)) * u(SEED)
    z = (z ^ z >> u(30)) * u(0xBF58476D1CE4E5B9)
    z = (z ^ z >> u(27)) * u(0x94D049BB133111EB)
    return z ^ z >> u(31)


@dataclass(frozen=True)
class Space:
    """Parameters that two markers must share to be comparable."""

    dims: int = 8
    bits: int = 8
    seed: int = SEED

    def __post_init__(self):
        check_space(self.dims, self.bits)

    @property
    def key_bits(self) -> int:
        return self.dims * self.bits

    @property
    def digits(self) -> int:
        return -(-self.key_bits // 4)

    @property
    def prefix(self) -> str:
        return f"hk1:{self.dims}:{self.bits}:{self.seed:016x}:"


@lru_cache(maxsize=8)
def _signs(width: int, dims: int, seed: int) -> np.ndarray:
    """[width, dims] of +1 and -1: bit j of the generator's i-th output turns input i on axis j around."""
    drawn = splitmix64(seed, np.arange(width))
    return np.where(drawn[:, None] >> np.arange(dims, dtype=np.uint64) & np.uint64(1), np.float32(-1), np.float32(1)).astype(np.float32)


def _sums(e: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signed sums per axis and the squared norm, in four running sums of 32 bits each: input i goes to sum i mod 4.

    Rows come last in tiles that stay in the cache, so that adding up along the
    first axis runs over whole vectors, in the order of the inputs.
    """
    extra = -e.shape[1] % 4
    signs = np.pad(signs, ((0, extra), (0, 0))).T[:, :, None]
    sums, norm = np.empty((len(e), len(signs)), np.float32), np.empty(len(e), np.float32)
    four = lambda x: x if x.shape[0] else np.zeros((1, *x.shape[1:]), np.float32)
    with np.errstate(over="ignore", invalid="ignore", under="ignore"):
        for at in range(0, len(e), TILE):
            rows = np.ascontiguousarray(np.pad(e[at : at + TILE], ((0, 0), (0, extra))).T)
            lanes = np.empty_like(rows)
            for axis, sign in enumerate(signs):
                np.multiply(rows, sign, out=lanes)
                a, b, c, d = np.add.reduce(four(lanes.reshape(-1, 4, rows.shape[1])), axis=0)
                sums[at : at + TILE, axis] = (a + b) + (c + d)
            np.multiply(rows, rows, out=lanes)
            a, b, c, d = np.add.reduce(four(lanes.reshape(-1, 4, rows.shape[1])), axis=0)
            norm[at : at + TILE] = (a + b) + (c + d)
    return sums, norm


def _exp(t: np.ndarray) -> np.ndarray:
    t = np.clip(t, -700.0, 700.0)
    scaled = t * 1.4426950408889634
    n = np.copysign(np.floor(np.abs(scaled) + 0.5), scaled)
    r = (t - n * 0.693145751953125) - n * 1.4286068203094172e-6
    p = np.full_like(r, 1.0 / 479001600)
    for d in FACTORIALS:
        p = p * r + 1.0 / d
    return p * np.ldexp(1.0, n.astype(np.int64))


def positions(e: np.ndarray, space: Space) -> tuple[np.ndarray, np.ndarray]:
    """Continuous cell units per axis, and an error code per row."""
    signs = _signs(e.shape[1], space.dims, space.seed)
    sums, norm = _sums(e, signs)
    code = np.zeros(len(e), np.int64)
    odd = np.flatnonzero(~((norm >= np.float32(2.0**-100)) & (norm <= np.finfo(np.float32).max)))
    if len(odd):
        rows = e[odd]
        most = np.abs(rows).max(axis=1, initial=0)
        code[odd] = np.where(~np.isfinite(rows).all(axis=1), 2, np.where(most == 0, 1, 0))
        # Powers of two in two steps: exact, and within the range of 32 bits.
        shift = np.where(code[odd] == 0, -np.frexp(np.where(np.isfinite(most), most, 1))[1], 0)
        half = np.trunc(shift / 2).astype(np.int64)
        with np.errstate(over="ignore", invalid="ignore"):
            rows = np.ldexp(np.ldexp(rows, half[:, None]).astype(np.float32), (shift - half)[:, None]).astype(np.float32)
        sums[odd], norm[odd] = _sums(rows, signs)
    with np.errstate(divide="ignore", invalid="ignore"):
        z = sums.astype(np.float64) / np.sqrt(norm.astype(np.float64))[:, None]
        z[code > 0] = 0
        return float(1 << space.bits) / (1.0 + _exp(-1.702 * z)), code


def cells_of(position: np.ndarray, bits: int) -> np.ndarray:
    return np.minimum(np.floor(position), float((1 << bits) - 1)).astype(np.uint64)


def _embedded(array, space: Space, invalid: str, width: int | None):
    """Positions of an embedding column; rows without: null, or invalid if those give null."""
    e, absent, odd = matrix(array, width)
    if e.shape[1] > MOST_INPUTS:
        raise errors.DimensionsOutOfRange(str(e.shape[1]))
    code = np.zeros(len(e), np.int64)
    found = np.zeros((len(e), space.dims))
    for at in range(0, len(e), ROWS):  # keeps the working set of wide batches small
        found[at : at + ROWS], code[at : at + ROWS] = positions(e[at : at + ROWS], space)
    code[odd], code[absent] = 3, 0
    if invalid == "raise" and code.any():
        raise ERRORS[int(code[code > 0][0])]()
    return found, absent | (code > 0), code


def _column(kind: str, space: Space, finish, invalid: str, width: int | None):
    @F.arrow_udf(kind)
    def embed(e):
        import pyarrow as pa

        position, none, _ = _embedded(e, space, invalid, width)
        return finish(pa, position, none)

    return embed


def _float_list(e) -> Column:
    return as_col(e).cast("array<float>")


def position(e, space: Space = Space(), *, invalid: str = "raise", width: int | None = None) -> Column:
    """ARRAY<DOUBLE>: where the embedding lies, in cell units."""
    return _column("array<double>", space, lambda pa, p, none: lists(p, pa.float64(), none), invalid, width)(_float_list(e))


def cell(e, space: Space = Space(), *, invalid: str = "raise", width: int | None = None) -> Column:
    """ARRAY<BIGINT>: the quantised coordinates."""
    return _column("array<long>", space, lambda pa, p, none: lists(cells_of(p, space.bits).view(np.int64), pa.int64(), none), invalid, width)(_float_list(e))


def key(e, space: Space = Space(), *, invalid: str = "raise", width: int | None = None) -> Column:
    """Hex key."""

    def finish(pa, p, none):
        return pa.array(hex_text(*encode_array(cells_of(p, space.bits), space.bits), space.digits), pa.string(), mask=none)

    return _column("string", space, finish, invalid, width)(_float_list(e))


def marker(e, space: Space = Space(), *, invalid: str = "raise", width: int | None = None) -> Column:
    """Marker text; ``invalid='null'`` gives null where ``marker_error`` names the reason."""
    return F.concat(F.lit(space.prefix), key(e, space, invalid=invalid, width=width))


def marker_error(e, space: Space = Space(), *, width: int | None = None) -> Column:
    """Name of the error of an embedding, null if it has none."""

    @F.arrow_udf("string")
    def error_name(x):
        import pyarrow as pa

        code = _embedded(x, space, "null", width)[2]
        return pa.array([ERRORS[c].__name__ if c else None for c in code.tolist()], pa.string())

    return error_name(_float_list(e))


def format_marker(key_hex, space: Space) -> Column:
    return F.concat(F.lit(space.prefix), as_col(key_hex))


def parse(text) -> Column:
    """STRUCT<dims, bits, seed, key> of a marker's canonical text; null for any other text."""
    text = as_col(text)
    field = lambda i: F.split(text, ":")[i]
    shaped = F.coalesce(text.rlike(r"\Ahk1:[1-9][0-9]?:[1-9][0-9]?:[0-9a-f]{16}:[0-9a-f]{1,32}\z"), F.lit(False))
    dims, bits = field(1).cast("int"), field(2).cast("int")
    total = dims * bits
    spare = F.pmod(-total, F.lit(4))  # unused high bits of the first digit
    first = F.conv(F.substring(field(4), 1, 1), 16, 10).cast("int")
    fits = (dims <= 32) & (bits <= 32) & (total <= 128) & (F.length(field(4)) == F.ceil(total / 4)) & (first < F.pow(F.lit(2), 4 - spare))
    return F.when(shaped, F.when(fits, F.struct(dims.alias("dims"), bits.alias("bits"), field(3).alias("seed"), field(4).alias("key"))))


def is_marker(text) -> Column:
    return parse(text).isNotNull()


def _bounds(key_hex: Column, keep: Column, digits: Column) -> tuple[Column, Column]:
    """The key with all but its first ``keep`` of 4 * digits bits cleared, and with them set."""
    whole = F.floor(keep / 4).cast("int")
    head = F.substr(key_hex, F.lit(1), whole)
    digit = F.conv(F.substr(key_hex, whole + 1, F.lit(1)), 16, 10).cast("int")
    part = F.call_function("shiftright", F.lit(15), keep % 4).cast("int")  # the free bits of the cut digit
    rest = F.greatest(digits - whole - 1, F.lit(0))
    low = F.lower(F.hex(digit.bitwiseAND(F.bitwise_not(part))))
    high = F.lower(F.hex(digit.bitwiseOR(part)))
    cut = keep >= digits * 4
    return (
        F.when(cut, key_hex).otherwise(F.concat(head, low, F.repeat(F.lit("0"), rest))),
        F.when(cut, key_hex).otherwise(F.concat(head, high, F.repeat(F.lit("f"), rest))),
    )


def _with(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, not once for each mention."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def key_range(text, level) -> Column:
    """STRUCT<lo, hi> of markers that share ``level`` bits per axis; levels above the marker's bits clamp, null for no marker."""
    level = F.lit(level) if isinstance(level, int) else level

    def bounds(m):
        digits = F.length(m["key"])
        keep = digits * 4 - m["dims"] * m["bits"] + m["dims"] * F.least(level, m["bits"])
        low, high = _bounds(m["key"], keep, digits)
        head = F.concat_ws(":", F.lit("hk1"), m["dims"].cast("string"), m["bits"].cast("string"), m["seed"])
        return F.when(m.isNotNull(), F.struct(F.concat_ws(":", head, low).alias("lo"), F.concat_ws(":", head, high).alias("hi")))

    return _with(parse(text), bounds)


def marker_cell(text, space: Space) -> Column:
    """ARRAY<BIGINT> of a marker of ``space``: the cell behind its key."""

    @F.arrow_udf("array<long>")
    def key_cell(keys):
        import pyarrow as pa

        none = np.asarray(keys.is_null())
        high, low = from_hex(keys.fill_null("0").to_pylist())
        return lists(decode_array(high, low, space.dims, space.bits).view(np.int64), pa.int64(), none)

    here = as_col(text).startswith(space.prefix)
    return key_cell(F.when(here, parse(text)["key"]))


def shared_prefix_bits(a, b) -> Column:
    """Common leading key bits of two markers; null if their spaces differ or one is no marker."""
    half = lambda m, i: F.conv(F.substr(F.lpad(m["key"], 32, "0"), F.lit(16 * i + 1), F.lit(16)), 16, -10).cast("long")

    def shared(pair):
        x, y = pair["x"], pair["y"]
        same = (x["dims"] == y["dims"]) & (x["bits"] == y["bits"]) & (x["seed"] == y["seed"])
        high, low = half(x, 0).bitwiseXOR(half(y, 0)), half(x, 1).bitwiseXOR(half(y, 1))
        width = F.when(high != 0, F.length(F.bin(high)) + 64).when(low != 0, F.length(F.bin(low))).otherwise(0)
        return F.when(same, x["dims"] * x["bits"] - width)

    return _with(F.struct(parse(a).alias("x"), parse(b).alias("y")), shared)


def _probe_rows(position: np.ndarray, space: Space, level: int, n: int, count_log: int) -> list[list[tuple[int, int]]]:
    """Per row, ranges (low, high) of the home cell and the cells across its nearest boundaries."""
    bits, dims = space.bits, space.dims
    scaled = position / float(1 << bits - level)
    home = np.minimum(np.floor(scaled), float((1 << level) - 1))
    frac = scaled - home
    step = np.where(frac < 0.5, -1.0, 1.0)
    beyond = home + step
    far = (beyond < 0) | (beyond > (1 << level) - 1)
    away = np.where(far, np.inf, np.where(step < 0, frac, 1 - frac))
    order = np.argsort(away, axis=1, kind="stable")
    k = np.minimum((~far).sum(axis=1), count_log)
    free = (1 << dims * (bits - level)) - 1
    out: list[list[tuple[int, int]]] = [[] for _ in position]
    for mask in range(1 << count_log):
        used = np.flatnonzero(mask >> k == 0)
        moved = home[used].copy()
        for b in range(count_log):
            if mask >> b & 1:
                axis = order[used, b]
                at = np.arange(len(used))
                moved[at, axis] = beyond[used, axis]
        high, low = encode_array(moved.astype(np.uint64) << np.uint64(bits - level), bits)
        for r, h, x in zip(used.tolist(), high.tolist(), low.tolist()):
            key = (h << 64 | x) & ~free
            out[r].append((key, key | free))
    return out


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted(ranges):
        if out and out[-1][1] + 1 >= low:
            out[-1] = out[-1][0], max(out[-1][1], high)
        else:
            out.append((low, high))
    return out


def probes(e, level: int, n: int = 8, space: Space = Space(), *, merged: bool = True, invalid: str = "raise", width: int | None = None) -> Column:
    """ARRAY<STRUCT<lo, hi>> of key ranges (hex) to search: the home cell at ``level`` and those across its
    ``floor(log2 n)`` nearest boundaries; adjacent ranges merge unless ``merged`` is false."""
    if n < 1:
        raise errors.OutputLengthMismatch(str(n))
    level = min(level, space.bits)

    def finish(pa, p, none):
        found = _probe_rows(p, space, level, n, n.bit_length() - 1) if level else [[(0, (1 << space.key_bits) - 1)] for _ in p]
        text = lambda x: f"{x:0{space.digits}x}"
        rows = [None if bad else [{"lo": text(a), "hi": text(b)} for a, b in (merge(r) if merged else sorted(r))] for r, bad in zip(found, none.tolist())]
        return pa.array(rows, pa.list_(pa.struct([("lo", pa.string()), ("hi", pa.string())])))

    return _column("array<struct<lo:string,hi:string>>", space, finish, invalid, width)(_float_list(e))


def cell_low(key_hex, level: int, space: Space = Space()) -> Column:
    """The first key of the cell at ``level`` that holds a key: what equal prefixes share."""
    spare = space.digits * 4 - space.key_bits
    return _bounds(as_col(key_hex), F.lit(spare + space.dims * min(level, space.bits)), F.lit(space.digits))[0]
