"""DuckDB SQL for the queries: independent folds over list states, built from the curve's and the keys' definitions."""

from __future__ import annotations

G = "11400714819323198485"  # 0x9e3779b97f4a7c15
TWO64 = "18446744073709551616::UHUGEINT"


def encode2(bits: int, x: str, y: str, kind: str = "BIGINT", along_y: str = "0") -> str:
    """By moving the point: in the first quadrant the curve is a transposed copy of the whole, in the last a copy
    transposed about the other diagonal, so the rest of the coordinates is mapped back and read as before."""
    start = f"{{'h': 0::{kind}, 'x': (CASE WHEN ({along_y}) = 1 THEN {y} ELSE {x} END)::{kind}, 'y': (CASE WHEN ({along_y}) = 1 THEN {x} ELSE {y} END)::{kind}}}"
    sides = f"list_transform(range({bits - 1}, -1, -1), lambda k: {{'h': (2 ** k)::{kind}, 'x': 0::{kind}, 'y': 0::{kind}}})"
    right, top, u, v = "a.x >= e.h", "a.y >= e.h", "(a.x % e.h)", "(a.y % e.h)"
    digit = f"(CASE WHEN {right} THEN (CASE WHEN {top} THEN 2 ELSE 3 END) ELSE (CASE WHEN {top} THEN 1 ELSE 0 END) END)::{kind}"
    moved = lambda own, other: f"CASE WHEN {top} THEN {own} WHEN {right} THEN e.h - 1::{kind} - {other} ELSE {other} END"
    return f"list_reduce({sides}, lambda a, e: {{'h': a.h * 4::{kind} + {digit}, 'x': {moved(u, v)}, 'y': {moved(v, u)}}}, {start}).h"


def decode2(bits: int, h: str) -> str:
    """The other way: from the smallest square up, each one is put into its quadrant of the next."""
    d, side = f"(({h} >> (2 * e.x)) & 3)", "(1::BIGINT << e.x::INT)"
    step = (
        f"lambda a, e: {{'x': CASE {d} WHEN 0 THEN a.y WHEN 1 THEN a.x WHEN 2 THEN a.x + {side} ELSE 2 * {side} - 1 - a.y END, "
        f"'y': CASE {d} WHEN 0 THEN a.x WHEN 3 THEN {side} - 1 - a.x ELSE a.y + {side} END}}"
    )
    return f"list_reduce(list_transform(range({bits}), lambda k: {{'x': k, 'y': 0::BIGINT}}), {step}, {{'x': 0::BIGINT, 'y': 0::BIGINT}})"


def _turns(dims: int, bits: int, up: bool) -> str:
    """A list of lists: [bit, axis] in the order in which the transform visits them."""
    ks = range(1, bits) if up else range(bits - 1, 0, -1)
    axes = range(dims, 0, -1) if up else range(1, dims + 1)
    return "[" + ", ".join(f"[{k}::BIGINT, {i}]" for k in ks for i in axes) + "]"


def _turned(point: str, dims: int, bits: int, up: bool) -> str:
    below = "((1::BIGINT << e[1]::INT) - 1)"
    has = "((a[e[2]] >> e[1]::INT) & 1) = 1"
    inner = f"CASE WHEN {has} THEN (CASE WHEN p = 1 THEN xor(a[p], {below}) ELSE a[p] END) WHEN p = 1 OR p = e[2] THEN xor(a[p], xor(a[1], a[e[2]]) & {below}) ELSE a[p] END"
    return f"list_reduce({_turns(dims, bits, up)}, lambda a, e: list_transform(range(1, {dims + 1}), lambda p: {inner}), {point})"


def encode_nd(source: str, key: str, point: str, dims: int, bits: int) -> str:
    """``(key, h UHUGEINT)`` of the rows of ``source``; ``point`` is a BIGINT[]."""
    gray = f"list_transform(range(1, {dims + 1}), lambda p: list_reduce(q[1:p], lambda u, v: xor(u, v)))"
    t = f"list_reduce(list_transform(range(1, {bits}), lambda k: CASE WHEN ((g[{dims}] >> k::INT) & 1) = 1 THEN (1::BIGINT << k::INT) - 1 ELSE 0 END), lambda u, v: xor(u, v), 0::BIGINT)"
    order = ", ".join(f"[{k}::BIGINT, {i}]" for k in range(bits - 1, -1, -1) for i in range(1, dims + 1))
    h = f"list_reduce(list_transform([{order}], lambda e: ((xor(g[e[2]], t) >> e[1]::INT) & 1)::UHUGEINT), lambda u, v: u * 2::UHUGEINT + v, 0::UHUGEINT)"
    return f"""SELECT {key}, {h} AS h FROM (SELECT {key}, g, {t} AS t FROM (SELECT {key}, {gray} AS g FROM (
        SELECT {key}, {_turned(point, dims, bits, False)} AS q FROM {source})))"""


def decode_nd(source: str, key: str, h: str, dims: int, bits: int) -> str:
    """``(key, p BIGINT[])``."""
    axis = f"list_transform(range(1, {dims + 1}), lambda p: list_reduce(list_transform(range({bits}), lambda l: ((({h}) >> (l * {dims} + {dims} - p)::INT) & 1) << l::INT), lambda u, v: u | v))"
    gray = f"list_transform(range(1, {dims + 1}), lambda p: CASE WHEN p = 1 THEN xor(x[1], x[{dims}] >> 1) ELSE xor(x[p], x[p - 1]) END)"
    return f"""SELECT {key}, {_turned('g', dims, bits, True)} AS p FROM (SELECT {key}, {gray} AS g FROM (SELECT {key}, {axis} AS x FROM {source}))"""


def splitmix(seed: str, i: str) -> str:
    """A scalar subquery-free chain: the i-th output as UHUGEINT below 2**64."""
    mul = lambda a, b: f"(({a}) * '{b}'::UHUGEINT % {TWO64})"
    z = f"(({seed})::UHUGEINT + ({i} + 1)::UHUGEINT * '{G}'::UHUGEINT) % {TWO64}"
    step = lambda v, shift: f"xor({v}, {v} >> {shift}::UHUGEINT)"
    return f"list_transform(list_transform(list_transform([{z}], lambda z: {mul(step('z', 30), 13787848793156543929)}), lambda z: {mul(step('z', 27), 10723151780598845931)}), lambda z: {step('z', 31)})[1]"


def hk1_positions(dims: int, bits: int, seed: str = G) -> str:
    """``(vec_id, j, p)``: where the embeddings, whose width is 64, lie on each axis."""
    lane = "list_reduce(list_transform(range(0, 16), lambda k: (e[4 * k + {a} + 1] * s[4 * k + {a} + 1])::FLOAT), lambda u, v: (u + v)::FLOAT, 0::FLOAT)"
    norm = "list_reduce(list_transform(range(0, 16), lambda k: (e[4 * k + {a} + 1] * e[4 * k + {a} + 1])::FLOAT), lambda u, v: (u + v)::FLOAT, 0::FLOAT)"
    four = lambda x: f"(({x.format(a=0)} + {x.format(a=1)})::FLOAT + ({x.format(a=2)} + {x.format(a=3)})::FLOAT)::FLOAT::DOUBLE"
    poly = "list_reduce([39916800, 3628800, 362880, 40320, 5040, 720, 120, 24, 6, 2, 1, 1]::DOUBLE[], lambda u, v: u * r + 1 / v, 1 / 479001600::DOUBLE)"
    return f"""
    SELECT vec_id, j, pow(2.0, {bits}) / (1 + {poly} * pow(2.0, n)) AS p FROM (
      SELECT vec_id, j, n, (t - n * 0.693145751953125) - n * 1.4286068203094172e-6 AS r FROM (
        SELECT vec_id, j, t, round(t * 1.4426950408889634) AS n FROM (
          SELECT vec_id, j, greatest(-700.0, least(700.0, -1.702 * ({four(lane)} / sqrt({four(norm)})))) AS t FROM (
            SELECT vec_id, embedding AS e, j, s FROM embeddings, (
              SELECT j, list(CASE WHEN (w >> j::UHUGEINT) & 1::UHUGEINT = 1::UHUGEINT THEN -1 ELSE 1 END::FLOAT ORDER BY i) AS s
              FROM (SELECT i, {splitmix(G if seed == G else seed, 'i')} AS w FROM range(64) x(i)), range({dims}) y(j) GROUP BY j)))))"""


def hk1_cells(dims: int, bits: int, seed: str = G) -> str:
    """``(vec_id, c BIGINT[])``."""
    return f"SELECT vec_id, list(least(floor(p), {(1 << bits) - 1})::BIGINT ORDER BY j) AS c FROM ({hk1_positions(dims, bits, seed)}) GROUP BY vec_id"


def hk1_probed(flips: int) -> str:
    """``(vec_id, mask, cell)``: the first digits pair of each key probed at level 1 of 8 axes, across the nearest ``flips`` boundaries."""
    sides = f"""
      SELECT vec_id, j, home, home + step AS beyond, home + step NOT BETWEEN 0 AND 1 AS far, CASE WHEN step < 0 THEN frac ELSE 1 - frac END AS away FROM (
        SELECT vec_id, j, home, p / 128 - home AS frac, CASE WHEN p / 128 - home < 0.5 THEN -1 ELSE 1 END AS step FROM (
          SELECT vec_id, j, p, least(floor(p / 128), 1)::BIGINT AS home FROM ({hk1_positions(8, 8)})))"""
    ranked = f"""
      SELECT vec_id, j, home, beyond, row_number() OVER (PARTITION BY vec_id ORDER BY far, away, j) - 1 AS nth, sum((NOT far)::INT) OVER (PARTITION BY vec_id) AS free FROM ({sides})"""
    moved = f"""(
      SELECT vec_id, mask, list((CASE WHEN nth < {flips} AND (mask >> least(nth, {flips})::INT) & 1 = 1 THEN beyond ELSE home END * 128)::BIGINT ORDER BY j) AS c
      FROM ({ranked}), range({1 << flips}) m(mask) WHERE mask >> least(free, {flips})::INT = 0 GROUP BY vec_id, mask)"""
    return f"SELECT vec_id, mask, (h >> 56::UHUGEINT)::BIGINT AS cell FROM ({encode_nd(moved, 'vec_id, mask', 'c', 8, 8)})"


def hk1_keys() -> str:
    """``(vec_id, key)`` in the default space."""
    return f"SELECT vec_id, printf('%016x', h::UBIGINT) AS key FROM ({encode_nd(f'({hk1_cells(8, 8)})', 'vec_id', 'c', 8, 8)})"


MARKERS = f"SELECT vec_id, 'hk1:8:8:9e3779b97f4a7c15:' || key AS marker FROM ({hk1_keys()})"

HK2_MARGINS = f"""
  SELECT vec_id, t, j, list_reduce(list_transform(range(1, 65), lambda i: e[i]::DOUBLE * s[i]), lambda u, v: u + v, 0::DOUBLE) AS m FROM (
    SELECT vec_id, embedding AS e, t, j, s FROM embeddings, (
      SELECT t, j, list(CASE WHEN (w >> j::UHUGEINT) & 1::UHUGEINT = 1::UHUGEINT THEN -1 ELSE 1 END::DOUBLE ORDER BY i) AS s FROM (
        SELECT t, i, {splitmix('seed', 'i')} AS w FROM (SELECT t, {splitmix(G, 't')} AS seed FROM range(16) x(t)), range(64) y(i)), range(8) z(j)
      GROUP BY t, j))"""
HK2 = f"SELECT vec_id, t, sum(CASE WHEN m > 0 THEN 1 << j::INT ELSE 0 END)::BIGINT AS key FROM ({HK2_MARGINS}) GROUP BY vec_id, t"
#: Of four probes the first three are the own key and those across the two least margins; the fourth crosses the third least, or the two least together.
HK2_PROBES = f"""
  SELECT vec_id, t, unnest([key, xor(key, a), xor(key, b), CASE WHEN w[3] <= w[1] + w[2] THEN xor(key, c) ELSE xor(xor(key, a), b) END]) AS key FROM (
    SELECT vec_id, t, key, w, 1 << o[1]::INT AS a, 1 << o[2]::INT AS b, 1 << o[3]::INT AS c FROM (
      SELECT vec_id, t, sum(CASE WHEN m > 0 THEN 1 << j::INT ELSE 0 END)::BIGINT AS key, list(abs(m) ORDER BY abs(m), j) AS w, list(j ORDER BY abs(m), j) AS o FROM ({HK2_MARGINS}) GROUP BY vec_id, t))"""
HK2_PAIRS = f"WITH k AS ({HK2}) SELECT DISTINCT a.vec_id AS query_id, b.vec_id AS id FROM k a JOIN k b USING (t, key) WHERE a.vec_id % 20 = 0"


def _topk(pairs: str) -> str:
    dot = lambda a, b: f"list_reduce(list_transform(range(1, 65), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE), lambda u, v: u + v, 0::DOUBLE)"
    cosine = f"{dot('q.embedding', 'd.embedding')} / (sqrt({dot('q.embedding', 'q.embedding')}) * sqrt({dot('d.embedding', 'd.embedding')}))"
    return f"""SELECT query_id, id, round(cosine, 6) AS cosine, rank::INT AS rank FROM (
      SELECT query_id, id, cosine, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS rank FROM (
        SELECT query_id, id, {cosine} AS cosine FROM ({pairs}) p JOIN embeddings q ON q.vec_id = query_id JOIN embeddings d ON d.vec_id = id))
    WHERE rank <= 10"""


_ST = lambda u: f"CASE WHEN {u} >= 0 THEN 0.5 * sqrt(1 + 3 * abs({u})) ELSE 1 - 0.5 * sqrt(1 + 3 * abs({u})) END"
_IJ = lambda s: f"CASE WHEN {s} > 0 THEN least(trunc(1073741824.0 * {s})::BIGINT, 1073741823) ELSE 0 END"

def _faced(key: str, points: str) -> str:
    """``(key, face, u, v)`` of ``points (key, x, y, z)``; ties go to the later axis."""
    return f"""
      SELECT {key}, face::INT AS face,
        CASE face WHEN 0 THEN y / x WHEN 1 THEN -x / y WHEN 2 THEN -x / z WHEN 3 THEN z / x WHEN 4 THEN z / y ELSE -y / z END AS u,
        CASE face WHEN 0 THEN z / x WHEN 1 THEN z / y WHEN 2 THEN -y / z WHEN 3 THEN y / x WHEN 4 THEN -x / y ELSE -x / z END AS v
      FROM (SELECT *, CASE WHEN abs(x) > abs(y) THEN (CASE WHEN abs(x) > abs(z) THEN (CASE WHEN x < 0 THEN 3 ELSE 0 END) ELSE (CASE WHEN z < 0 THEN 5 ELSE 2 END) END)
            WHEN abs(y) > abs(z) THEN (CASE WHEN y < 0 THEN 4 ELSE 1 END) ELSE (CASE WHEN z < 0 THEN 5 ELSE 2 END) END AS face FROM ({points}))"""


def _point_on(face: str, u: str, v: str) -> str:
    """``x, y, z`` of a place on a face."""
    axes = (("1", f"-{u}", f"-{u}", "-1", v, v), (u, "1", f"-{v}", f"-{v}", "-1", u), (v, v, "1", f"-{u}", f"-{u}", "-1"))
    return ", ".join(f"(CASE {face} {' '.join(f'WHEN {k} THEN {e}' for k, e in enumerate(own))} END)::DOUBLE AS {name}" for name, own in zip("xyz", axes))


def _leaf_id(face: str, i: str, j: str) -> str:
    return f"({face}::UHUGEINT * (1::UHUGEINT << 61) + ({encode2(30, i, j, along_y=f'{face} % 2')})::UHUGEINT * 2::UHUGEINT + 1::UHUGEINT)::UBIGINT"


#: ``(c_custkey, face, i, j)`` of the points that the queries derive, and ``(c_custkey, id UBIGINT, face)``.
FACE_IJ = f"""
  SELECT c_custkey, face, {_IJ('s')} AS i, {_IJ('t')} AS j FROM (
    SELECT c_custkey, face, {_ST('u')} AS s, {_ST('v')} AS t FROM ({_faced('c_custkey', """
      SELECT c_custkey, cos(phi) * cos(theta) AS x, cos(phi) * sin(theta) AS y, sin(phi) AS z FROM (
        SELECT c_custkey, ((c_custkey * 7919 % 17901)::DOUBLE / 100.0::DOUBLE - 89.5::DOUBLE) * (pi() / 180.0::DOUBLE) AS phi,
          ((c_custkey * 104729 % 36000)::DOUBLE / 100.0::DOUBLE - 180.0::DOUBLE) * (pi() / 180.0::DOUBLE) AS theta FROM customer)""")}))"""
LEAVES = f"SELECT c_custkey, {_leaf_id('face', 'i', 'j')} AS id, face FROM ({FACE_IJ})"


def _raised(bits: str, c: str = "id") -> str:
    """The ancestor of a leaf whose lowest set bit is at ``bits``."""
    bit = f"(1::UHUGEINT << ({bits})::UHUGEINT)"
    return f"(({c}::UHUGEINT // (2::UHUGEINT * {bit})) * (2::UHUGEINT * {bit}) + {bit})::UBIGINT"


def _beside(steps: str, bits: str) -> str:
    """``(c_custkey, k, bits, id)``: cells beside those of size ``2 ** bits`` that hold the points; ``steps (k, di, dj)``.

    Off the face, the place one unit beyond its edge is seen from the neighbouring face, on a linear scale.
    """
    size, off = "(1::BIGINT << bits::INT)", "NOT (ci BETWEEN 0 AND 1073741823 AND cj BETWEEN 0 AND 1073741823)"
    middle = lambda x: f"({x} // {size}) * {size} + {size} // 2"
    moved = f"SELECT c_custkey, k, bits, face, {middle('i')} + di * {size} AS ci, {middle('j')} + dj * {size} AS cj FROM (SELECT *, ({bits})::BIGINT AS bits FROM ({FACE_IJ})), ({steps})"
    flat = lambda x: f"greatest(-1.0000000000000002, least(1.0000000000000002, (2.0 * (greatest(-1, least({x}, 1073741824)) - 536870912) + 1) / 1073741824.0::DOUBLE))"
    seen = _faced("c_custkey, k, bits", f"SELECT c_custkey, k, bits, {_point_on('face', 'u', 'v')} FROM (SELECT c_custkey, k, bits, face, {flat('ci')} AS u, {flat('cj')} AS v FROM ({moved}) WHERE {off})")
    unit = lambda x: _IJ(f"(0.5 * ({x} + 1))")
    placed = f"SELECT c_custkey, k, bits, face, ci, cj FROM ({moved}) WHERE NOT ({off}) UNION ALL SELECT c_custkey, k, bits, face, {unit('u')}, {unit('v')} FROM ({seen})"
    return f"SELECT c_custkey, k, bits, {_raised('2 * bits')} AS id FROM (SELECT c_custkey, k, bits, {_leaf_id('face', 'ci', 'cj')} AS id FROM ({placed}))"


_UV = lambda s: f"CASE WHEN {s} >= 0.5 THEN (1.0::DOUBLE / 3.0::DOUBLE) * (4 * {s} * {s} - 1) ELSE (1.0::DOUBLE / 3.0::DOUBLE) * (1 - 4 * (1 - {s}) * (1 - {s})) END"
_MIDDLE = lambda x: f"((({x} >> 20) << 20) + 524288) / 1073741824.0::DOUBLE"
CENTRES = f"""
  SELECT c_custkey, round(atan2(z, sqrt(x * x + y * y)) * (180.0::DOUBLE / pi()), 9) AS lat, round(atan2(y, x) * (180.0::DOUBLE / pi()), 9) AS lng FROM (
    SELECT c_custkey, {_point_on('face', 'u', 'v')} FROM (
      SELECT c_custkey, face, {_UV('s')} AS u, {_UV('t')} AS v FROM (SELECT c_custkey, face, {_MIDDLE('i')} AS s, {_MIDDLE('j')} AS t FROM ({FACE_IJ}))))"""
#: Half the bits below a cell a disc of so many metres fits in, with its neighbours.
_DISC = "30 - greatest(0, least(30, floor(log2((pi() / 2 * 6371010.0::DOUBLE) / (c_custkey * 10.0::DOUBLE))) - 1))"


def _parent(level: int, c: str = "id") -> str:
    bit = 1 << 2 * (30 - level)
    return f"((({c} // {2 * bit}::UBIGINT) * {2 * bit}::UBIGINT) + {bit}::UBIGINT)"


_TOKEN = lambda c: f"rtrim(printf('%016x', {c}), '0')"
_XY = "(SELECT l_orderkey, l_linenumber, l_partkey & 65535 AS x, l_suppkey & 65535 AS y FROM lineitem)"
_H = "(SELECT o_orderkey, (o_orderkey * 7919 + o_custkey * 104729) % 4294967296 AS h FROM orders)"
_AXES = "[" + ", ".join(f"(c_custkey * {2 * i + 1} + {37 * i}) % 256" for i in range(16)) + "]"
_QUARTER = 1 << 34

ORACLES: dict[str, str] = {
    "curve2d_encode": f"SELECT l_orderkey, l_linenumber, {encode2(16, 'x', 'y')} AS h FROM {_XY}",
    "curve2d_decode": f"SELECT o_orderkey, p.x AS x, p.y AS y FROM (SELECT o_orderkey, {decode2(16, 'h')} AS p FROM {_H})",
    "curve2d_roundtrip": f"SELECT o_orderkey, h, true AS same FROM {_H}",
    "curve2d_order32": f"SELECT o_orderkey, printf('%016x', ({encode2(32, '(o_orderkey * 2654435761) % 4294967296', '((o_custkey * 40503 + o_orderkey) * 65537) % 4294967296', 'UHUGEINT')})::UBIGINT) AS h FROM orders",
    "curve_clustered_sort": f"SELECT p_partkey, {encode2(16, 'p_partkey % 65536', 'p_size')} AS h FROM part ORDER BY h, p_partkey",
    "curve_density": f"SELECT h >> 16 AS cell, count(*) AS n FROM (SELECT {encode2(16, 'x', 'y')} AS h FROM {_XY}) GROUP BY 1",
    "curvend_encode": f"SELECT l_orderkey, l_linenumber, h::BIGINT AS h FROM ({encode_nd('lineitem', 'l_orderkey, l_linenumber', '[l_orderkey % 1024, l_partkey % 1024, l_suppkey % 1024]', 3, 10)})",
    "curvend_decode": f"SELECT l_orderkey, l_linenumber, p[1] AS x0, p[2] AS x1, p[3] AS x2 FROM ({decode_nd('lineitem', 'l_orderkey, l_linenumber', '(l_orderkey * 7919 + l_partkey * 31 + l_linenumber) % 1073741824', 3, 10)})",
    "curvend_wide": f"SELECT c_custkey, printf('%016x', (h >> 64::UHUGEINT)::UBIGINT) || printf('%016x', (h % {TWO64})::UBIGINT) AS h, true AS same FROM ({encode_nd('customer', 'c_custkey', _AXES, 16, 8)})",
    "curve_walk": f"SELECT i AS \"index\", p[1] AS x0, p[2] AS x1, p[3] AS x2 FROM ({decode_nd('(SELECT 12345 + unnest(range((SELECT count(*) * 10 FROM supplier))) AS i)', 'i', 'i', 3, 10)})",
    "hk1_cell": f"SELECT vec_id, {', '.join(f'c[{i + 1}] AS x{i}' for i in range(8))} FROM ({hk1_cells(8, 8)})",
    "hk1_marker": MARKERS,
    "hk1_range": f"SELECT vec_id, left(marker, 25 + 6) || '0000000000' AS lo, left(marker, 25 + 6) || 'ffffffffff' AS hi FROM ({MARKERS})",
    "hk1_shared_prefix": f"WITH k AS ({hk1_keys()}), h AS (SELECT vec_id, ('0x' || key)::UBIGINT AS v FROM k) SELECT a.vec_id, CASE WHEN a.v = b.v THEN 64 ELSE 63 - floor(log2(xor(a.v, b.v)::DOUBLE))::INT END::INT AS bits FROM h a JOIN h b ON b.vec_id = a.vec_id - 1",
    "hk1_parse": f"SELECT vec_id, form, form = 0 AS valid, CASE WHEN form = 0 THEN key END AS key FROM ({hk1_keys()}), (SELECT unnest([0, 1, 2, 3, 4])::INT AS form)",
    "hk2_marker": f"SELECT vec_id, 'hk2:16:8:9e3779b97f4a7c15:' || string_agg(printf('%02x', key), '.' ORDER BY t) AS marker FROM ({HK2}) GROUP BY vec_id",
    "hk2_parse": f"SELECT vec_id, 16::INT AS tables, 8::INT AS bits, '9e3779b97f4a7c15' AS seed, t::INT AS t, key FROM ({HK2})",
    "hk2_bucket_sizes": f"SELECT t::INT AS t, key, count(*) AS n FROM ({HK2}) GROUP BY t, key",
    "hk2_collisions": HK2_PAIRS,
    "hk2_topk": _topk(HK2_PAIRS),
    "s2_leaf": f"SELECT c_custkey, printf('%016x', id) AS id, {_TOKEN('id')} AS token, face, (id % 2305843009213693952::UBIGINT)::BIGINT AS pos, 30::INT AS level, true AS valid FROM ({LEAVES})",
    "s2_hierarchy": f"SELECT c_custkey, {_TOKEN('p')} AS parent, 12::INT AS level, printf('%016x', p - {4 * _QUARTER - 1}::UBIGINT) AS lo, printf('%016x', p + {4 * _QUARTER - 1}::UBIGINT) AS hi, true AS holds, k::INT AS k, {_TOKEN(f'(p - {3 * _QUARTER}::UBIGINT + k::UBIGINT * {2 * _QUARTER}::UBIGINT)')} AS child FROM (SELECT c_custkey, {_parent(12)} AS p FROM ({LEAVES})), range(4) x(k)",
    "s2_density": f"SELECT {_TOKEN('c')} AS cell, count(*) AS n FROM (SELECT {_parent(4)} AS c FROM ({LEAVES})) GROUP BY c",
    "s2_token_roundtrip": "SELECT c_custkey, true AS same, true AS refused FROM customer",
    "merge_ranges": """
      SELECT l_suppkey, min(a) AS lo, max(b) AS hi FROM (
        SELECT *, sum(starts) OVER (PARTITION BY l_suppkey ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM (
          SELECT *, CASE WHEN a > 1 + max(b) OVER (PARTITION BY l_suppkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS starts
          FROM (SELECT l_suppkey, l_partkey AS a, l_partkey + l_quantity::BIGINT AS b FROM lineitem)))
      GROUP BY l_suppkey, island""",
}
_ALL_PAIRS = "SELECT a.vec_id AS query_id, b.vec_id AS id FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0"
ORACLES |= {
    "hk1_topk": _topk(_ALL_PAIRS),
    "hk1_position": f"SELECT vec_id, j::INT AS axis, round(p, 6) AS p FROM ({hk1_positions(8, 8)})",
    "hk1_probe_ranges": f"""
      SELECT vec_id, (row_number() OVER (PARTITION BY vec_id ORDER BY min(cell)) - 1)::INT AS "at", printf('%02x', min(cell)) || '00000000000000' AS lo, printf('%02x', max(cell)) || 'ffffffffffffff' AS hi
      FROM (SELECT vec_id, cell, cell - row_number() OVER (PARTITION BY vec_id ORDER BY cell) AS island FROM (SELECT DISTINCT vec_id, cell FROM ({hk1_probed(3)}))) GROUP BY vec_id, island""",
    "hk1_candidates": f"SELECT q.vec_id AS query_id, k.vec_id AS id FROM ({hk1_probed(2)}) q JOIN ({hk1_keys()}) k ON ('0x' || left(k.key, 2))::BIGINT = q.cell WHERE q.vec_id % 20 = 0",
    "hk1_range_filter": f"SELECT vec_id, marker FROM ({MARKERS}) WHERE left(right(marker, 16), 1) BETWEEN '1' AND '5' OR left(right(marker, 16), 2) BETWEEN 'c4' AND 'df'",
    "hk1_prefix_filter": f"SELECT vec_id, marker FROM ({MARKERS}) WHERE substr(marker, 26, 1) = '7'",
    "hk1_first_failing": "SELECT min(vec_id) AS vec_id, 'ZeroVector' AS error FROM embeddings WHERE vec_id % 11 = 10",
    "hk2_margins": f"SELECT vec_id, t::INT AS t, j::INT AS j, round(m, 6) AS margin FROM ({HK2_MARGINS})",
    "hk2_multiprobe": f"WITH k AS ({HK2}), p AS ({HK2_PROBES}) SELECT DISTINCT p.vec_id AS query_id, k.vec_id AS id FROM p JOIN k USING (t, key) WHERE p.vec_id % 20 = 0",
    "hk2_recall": f"SELECT count(c.id) AS hits, count(*) AS wanted, round(count(c.id)::DOUBLE / count(*), 6) AS recall FROM ({_topk(_ALL_PAIRS)}) t LEFT JOIN ({HK2_PAIRS}) c ON c.query_id = t.query_id AND c.id = t.id",
    "curve_checksum": f"SELECT count(*) AS n, bit_xor(h) AS h_xor, sum(h)::DECIMAL(38, 0) AS h_sum FROM (SELECT {encode2(16, 'x', 'y')} AS h FROM {_XY})",
    "sql_functions": f"SELECT l_orderkey, l_linenumber, {encode2(16, 'x', 'y')} AS h, true AS same FROM {_XY}",
    "s2_at_level": f"SELECT c_custkey, {_TOKEN(_parent(7))} AS token FROM ({LEAVES})",
    "s2_from_face_ij": f"SELECT c_custkey, printf('%016x', {_leaf_id('f', 'i', 'j')}) AS id, {_TOKEN('(f::UBIGINT * 2305843009213693952::UBIGINT + 1152921504606846976::UBIGINT)')} AS face FROM (SELECT c_custkey, c_custkey % 6 AS f, c_custkey * {7919 * 65537} % 1073741824 AS i, c_custkey * {104729 * 4099} % 1073741824 AS j FROM customer)",
    "s2_range_filter": f"SELECT c_custkey, printf('%016x', id) AS id FROM ({LEAVES}) WHERE id BETWEEN {(2 << 61) + (1 << 60)}::UBIGINT AND {(4 << 61) + (1 << 60)}::UBIGINT",
    "s2_nested": f"SELECT DISTINCT {_TOKEN(_parent(2))} AS outer_cell, {_TOKEN(_parent(5))} AS inner_cell FROM ({LEAVES}) WHERE c_custkey % 2 = 0",
    "s2_center": CENTRES,
    "s2_neighbours": f"SELECT c_custkey, k::INT AS edge, {_TOKEN('id')} AS token FROM ({_beside('SELECT * FROM (VALUES (0, 0, -1), (1, 1, 0), (2, 0, 1), (3, -1, 0)) s(k, di, dj)', '20')})",
    "s2_covering": f"""
      SELECT c_custkey, (row_number() OVER (PARTITION BY c_custkey ORDER BY id) - 1)::INT AS "at", printf('%016x', id - w + 1::UBIGINT) AS lo, printf('%016x', id + w - 1::UBIGINT) AS hi
      FROM (SELECT DISTINCT c_custkey, id, (1::UHUGEINT << (2 * bits)::UHUGEINT)::UBIGINT AS w FROM ({_beside('SELECT di * 3 + dj AS k, di, dj FROM range(-1, 2) a(di), range(-1, 2) b(dj)', _DISC)}))""",
}
ORACLES["curve2d_encode_fold"] = ORACLES["curve2d_encode"]
ORACLES["hk1_marker_cell"] = ORACLES["hk1_cell"]
ORACLES["hk1_pruned_topk"] = ORACLES["hk1_topk"]
ORACLES["curve_walk_source"] = f"SELECT o_orderkey, p[1] AS x0, p[2] AS x1, p[3] AS x2 FROM ({decode_nd('orders', 'o_orderkey', 'o_orderkey', 3, 10)})"
#: ``(query_id, id)``: in each of 128 trees of 24 bits, the six rows on either side of a query's place, which is before its own key.
_FOREST = f"""
  WITH drawn AS (
    SELECT t, j, list(CASE WHEN (w >> j::UHUGEINT) & 1::UHUGEINT = 1::UHUGEINT THEN -1 ELSE 1 END::DOUBLE ORDER BY i) AS s FROM (
      SELECT t, i, {splitmix('seed', 'i')} AS w FROM (SELECT t, {splitmix(G, 't')} AS seed FROM range(128) x(t)), range(64) y(i)), range(24) z(j)
    GROUP BY t, j),
  keys AS (
    SELECT vec_id, t, sum(CASE WHEN list_dot_product(embedding::DOUBLE[], s) > 0 THEN 1 << j::INT ELSE 0 END)::BIGINT AS key FROM embeddings, drawn GROUP BY vec_id, t),
  placed AS (
    SELECT vec_id, t, row_number() OVER (PARTITION BY t ORDER BY key, vec_id) - 1 AS place, rank() OVER (PARTITION BY t ORDER BY key) - 1 AS own FROM keys)
  SELECT DISTINCT q.vec_id AS query_id, d.vec_id AS id FROM placed q JOIN placed d ON d.t = q.t AND d.place >= q.own - 6 AND d.place < q.own + 6 WHERE q.vec_id % 20 = 0"""
ORACLES["hk2_forest_topk"] = _topk(_FOREST)
ORACLES["hk2_forest_recall"] = f"SELECT count(c.id) AS hits, count(*) AS wanted, round(count(c.id)::DOUBLE / count(*), 6) AS recall FROM ({_topk(_ALL_PAIRS)}) t LEFT JOIN ({_FOREST}) c ON c.query_id = t.query_id AND c.id = t.id"

_CENTRE = "(s_suppkey * 7919 % 12001)::DOUBLE / 100.0::DOUBLE - 60 AS lat, (s_suppkey * 104729 % 34000)::DOUBLE / 100.0::DOUBLE - 170 AS lng"
_UNIT = lambda lat, lng: f"array_value(cos(radians({lat})) * cos(radians({lng})), cos(radians({lat})) * sin(radians({lng})), sin(radians({lat})))"
_INNER = lambda a, b: f"array_inner_product({a}, {b})"
_OUTER = lambda a, b: f"array_cross_product({a}, {b})"
_SIZE = lambda a: f"sqrt({_INNER(a, a)})"
_CHORD = lambda a, b: f"array_distance({a}, {b})"


def _arc_within(a: str, b: str, r: str) -> str:
    n = _OUTER(a, b)
    over = f"{_INNER(_OUTER(n, a), 'p')} > 0 AND {_INNER(_OUTER(b, n), 'p')} > 0"
    return f"(CASE WHEN {over} THEN asin(least(1, abs({_INNER(n, 'p')}) / {_SIZE(n)})) ELSE 2 * asin(least({_CHORD(a, 'p')}, {_CHORD(b, 'p')}) / 2) END <= {r})"


def _in_triangle(a: str, b: str, c: str) -> str:
    turn = f"sign({_INNER(_OUTER(a, b), c)})"
    return "(" + " AND ".join(f"{turn} * {_INNER(_OUTER(x, y), 'p')} >= 0" for x, y in ((a, b), (b, c), (c, a))) + ")"


#: Customers and suppliers' regions: a disc by its chord, a line by the distance from its two arcs, a dented ring as two triangles.
ORACLES["s2_points_in_regions"] = f"""
  WITH points AS (
    SELECT c_custkey AS id, {_UNIT('lat', 'lng')} AS p FROM (
      SELECT c_custkey, (c_custkey * 7919 % 17901)::DOUBLE / 100.0::DOUBLE - 89.5 AS lat, (c_custkey * 104729 % 36000)::DOUBLE / 100.0::DOUBLE - 180 AS lng FROM customer)),
  regions AS (
    SELECT s_suppkey AS k, {', '.join(f"{_UNIT(f'(lat + {x})', f'(lng + {y})')} AS {name}" for name, x, y in (('c', 0, 0), ('l1', 6, 8), ('l2', 2, 15), ('r0', -8, -8), ('r1', 9, 0), ('r2', -8, 8), ('r3', -3, 0)))}
    FROM (SELECT s_suppkey, {_CENTRE} FROM supplier))
  SELECT id, k AS region_id FROM points, regions
  WHERE CASE k % 3
    WHEN 0 THEN {_CHORD('c', 'p')} <= 2 * sin((200000 + k % 20 * 50000) / 6371010.0::DOUBLE / 2)
    WHEN 1 THEN {_arc_within('c', 'l1', '((150000 + k % 10 * 20000) / 6371010.0::DOUBLE)')} OR {_arc_within('l1', 'l2', '((150000 + k % 10 * 20000) / 6371010.0::DOUBLE)')}
    ELSE {_in_triangle('r0', 'r1', 'r3')} OR {_in_triangle('r1', 'r2', 'r3')} END"""


def _cap_cells() -> str:
    """``(k, level, face, i, j, inside)``: quarters of cells as long as they meet a supplier's disc, and no further where they lie in it."""
    corner = lambda di, dj: _point_on("face", _UV(f"((i + {di}) / (1 << level)::DOUBLE)"), _UV(f"((j + {dj}) / (1 << level)::DOUBLE)")).replace(" AS ", f" AS c{di}{dj}")
    corners = [(0, 0), (1, 0), (1, 1), (0, 1)]
    v = lambda di, dj: f"array_value(c{di}{dj}x, c{di}{dj}y, c{di}{dj}z)"
    unit = lambda x: f"array_value({', '.join(f'({x})[{k}] / {_SIZE(x)}' for k in (1, 2, 3))})"
    angle = lambda a, b: f"acos(greatest(-1, least(1, {_INNER(a, b)})))"
    judge = lambda rows: f"""
      SELECT k, lat, lng, level, face, i, j, {angle('m', 'c')} <= r + a AS meets, {angle('m', 'c')} + a <= r AS inside FROM (
        SELECT *, greatest({', '.join(angle('c', f'v{n}') for n in range(4))}) AS a, {_UNIT('lat', 'lng')} AS m, (200000 + k % 20 * 50000) / 6371010.0::DOUBLE AS r FROM (
          SELECT *, {unit('s')} AS c FROM (
            SELECT *, array_value({', '.join(f'v0[{k}] + v1[{k}] + v2[{k}] + v3[{k}]' for k in (1, 2, 3))}) AS s FROM (
              SELECT k, lat, lng, level, face, i, j, {', '.join(f'{unit(v(*d))} AS v{n}' for n, d in enumerate(corners))} FROM (
                SELECT *, {', '.join(corner(*d) for d in corners)} FROM ({rows}))))))"""  # noqa: E731
    faces = f"SELECT s_suppkey AS k, {_CENTRE}, 0 AS level, f AS face, 0 AS i, 0 AS j FROM supplier, range(6) x(f) WHERE s_suppkey % 3 = 0"
    quarters = "SELECT k, lat, lng, level + 1 AS level, face, 2 * i + di AS i, 2 * j + dj AS j FROM t, range(2) y(di), range(2) z(dj) WHERE meets AND NOT inside AND level < 5"
    return f"WITH RECURSIVE t AS ({judge(faces)} UNION ALL {judge(quarters)}) SELECT k, level, face, i, j, inside FROM t WHERE meets AND (inside OR level = 5)"


_CAP_CELLS = f"SELECT k, level, inside, {_raised('2 * (30 - level)')} AS id FROM (SELECT *, {_leaf_id('face', '(i::BIGINT << (30 - level)::INT)', '(j::BIGINT << (30 - level)::INT)')} AS id FROM ({_cap_cells()}))"
ORACLES["s2_cover"] = f"SELECT k AS region_id, {_TOKEN('id')} AS token, level::INT AS level, inside FROM ({_CAP_CELLS})"
ORACLES["s2_points_in_cover"] = f"SELECT l.c_custkey AS id, c.k AS region_id FROM ({LEAVES}) l JOIN ({_CAP_CELLS}) c ON {_raised('2 * (30 - c.level)', 'l.id')} = c.id"
ORACLES["merge_ranges_one_group"] = """
  SELECT 'all' AS name, min(a) AS lo, max(b) AS hi FROM (
    SELECT *, sum(starts) OVER (ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM (
      SELECT *, CASE WHEN a > 1 + max(b) OVER (ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS starts
      FROM (SELECT o_orderkey * 7919 % 1000003 AS a, o_orderkey * 7919 % 1000003 + o_custkey % 60 AS b FROM orders)))
  GROUP BY island"""
ORACLES["range_join"] = f"""
  SELECT range_id, o_orderkey AS id FROM {_H} JOIN (
    SELECT s_suppkey AS range_id, s_suppkey * 799819 % 67108864 AS lo, s_suppkey * 799819 % 67108864 + s_suppkey * 7919 % 50 * 1000003 AS hi FROM supplier) ON h BETWEEN lo AND hi"""
ORACLES["range_join_wide"] = f"""
  SELECT range_id, c_custkey AS id FROM ({ORACLES["curvend_wide"]}) JOIN (
    SELECT s_suppkey AS range_id, printf('%08x', s_suppkey * 2654435761 % 4294967296) || '80000000000000000000001f' AS lo,
      printf('%08x', least(s_suppkey * 2654435761 % 4294967296 + s_suppkey * 10007 % 90 * 1000003, 4294967295)) || '7fffffffffffffff12345678' AS hi FROM supplier) ON h BETWEEN lo AND hi"""
_WRONG = "CASE vec_id % 23 WHEN 3 THEN 'ZeroVector' WHEN 5 THEN '63 numbers where 64 are due' WHEN 7 THEN 'no array of numbers found' {long}END"
ORACLES |= {
    "embedding_lines": f"SELECT vec_id, {_WRONG.format(long="WHEN 11 THEN 'line over the limit of 8000 bytes: 9000' ")} AS error, (CASE vec_id % 23 WHEN 5 THEN 63 WHEN 7 THEN NULL ELSE 64 END)::INT AS width FROM embeddings",
    "numbered_lines": "SELECT count(*) AS n, 0::BIGINT AS wrong FROM orders",
    "point_lines": f"SELECT CASE WHEN c_custkey % 9 = 0 THEN 'not two numbers' ELSE {_TOKEN(_parent(12))} END AS token, count(*) AS n FROM ({LEAVES}) GROUP BY 1",
    "marker_text": MARKERS,
    "marker_json": MARKERS,
    "hash_json": f"SELECT vec_id, 'hk2:16:8:9e3779b97f4a7c15:' || keys AS marker, keys FROM (SELECT vec_id, string_agg(printf('%02x', key), '.' ORDER BY t) AS keys FROM ({HK2}) GROUP BY vec_id)",
    "range_text": f"SELECT DISTINCT (p - {(1 << 52) - 1}::UBIGINT)::VARCHAR AS lo, (p + {(1 << 52) - 1}::UBIGINT)::VARCHAR AS hi FROM (SELECT {_parent(4)} AS p FROM ({LEAVES}))",
    "marker_stream": f"SELECT vec_id, CASE WHEN e IS NULL THEN marker END AS marker, e AS error FROM (SELECT vec_id, marker, {_WRONG.format(long='')} AS e FROM ({MARKERS}))",
}
ORACLES |= {
    "sql_names": f"SELECT vec_id, marker, keys FROM ({MARKERS}) JOIN (SELECT vec_id, string_agg(printf('%02x', key), '.' ORDER BY t) AS keys FROM ({HK2}) GROUP BY vec_id) USING (vec_id)",
    "sql_cells": ORACLES["s2_at_level"],
    "sql_probe_ranges": f"SELECT vec_id, lo, hi FROM ({ORACLES['hk1_probe_ranges']})",
    "sql_cover_regions": f"SELECT region_id, token, inside FROM ({ORACLES['s2_cover']})",
    "sql_cover_cells": f"SELECT DISTINCT c_custkey, {_TOKEN('id')} AS token FROM ({_beside('SELECT di * 3 + dj AS k, di, dj FROM range(-1, 2) a(di), range(-1, 2) b(dj)', _DISC)})",
    "sql_walks": f"""SELECT s_suppkey, "at", p[1] AS x0, p[2] AS x1, p[3] AS x2 FROM ({decode_nd('(SELECT s_suppkey, s_suppkey * 7919 + k AS "at" FROM supplier, range(5) r(k))', 's_suppkey, "at"', '"at"', 3, 10)})""",
    "hk1_written_filter": ORACLES["hk1_range_filter"],
    "hk1_rescaled": f"SELECT vec_id, marker, true AS same FROM ({MARKERS})",
    "hk2_first_failing": "SELECT min(vec_id) AS vec_id, 'DimensionMismatch' AS error FROM embeddings WHERE vec_id % 13 = 7",
    "curve2d_points": f"SELECT o_orderkey, h FROM {_H}",
}
