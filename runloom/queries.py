"""Queries of the array operators over the test tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom import config
from runloom.functions import scalar
from runloom.operators import convolve, manipulate, voxels
from runloom.operators import reduce as red
from runloom.operators import tensor as T
from runloom.plans import runs
from runloom.sources import levels, synthetic, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

SOURCES = {"E": tables.event_types, "D": tables.event_days, "O": tables.order_states, "G": tables.line_grid, "M": tables.embedding_grid}
CELLS = 29400
BIND = {
    "E": "SELECT event_id AS pos, CAST(CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS INTEGER) AS val FROM events",
    "D": "SELECT event_id AS pos, CAST(extract(day FROM ts) AS INTEGER) AS val FROM events",
    "O": "SELECT o_orderkey AS pos, CAST(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS INTEGER) AS val FROM orders",
    "G": f"SELECT r.range AS pos, CAST(coalesce(n, 0) AS INTEGER) AS val FROM range({CELLS}) r LEFT JOIN (SELECT CAST((l_linenumber - 1) + 7 * (CAST(l_quantity AS BIGINT) - 1) + 350 * ((extract(year FROM l_shipdate) - 1995) * 12 + extract(month FROM l_shipdate) - 1) AS BIGINT) AS p, count(*) AS n FROM lineitem GROUP BY 1) c ON c.p = r.range",
    "M": "SELECT vec_id * 64 + i - 1 AS pos, CAST(floor(CAST(embedding[i] AS DOUBLE) * 8) AS INTEGER) AS val FROM embeddings, range(1, 65) t(i)",
}


def with_(names: str, *ctes: str) -> str:
    return "WITH " + ", ".join([f"{n} AS ({BIND[n]})" for n in names] + list(ctes))


RUNS = "B AS (SELECT pos, val, CASE WHEN val IS DISTINCT FROM lag(val) OVER (ORDER BY pos) OR pos = 0 THEN 1 ELSE 0 END AS brk FROM T), K AS (SELECT pos, val, sum(brk) OVER (ORDER BY pos) AS g FROM B)"
RUNS_OUT = "SELECT min(pos) AS start_pos, max(pos) + 1 AS end_pos, min(val) AS val FROM K GROUP BY g"


def runs_sql(names: str, select: str, *ctes: str) -> str:
    """Runs of the cells that ``select`` gives."""
    return f"{with_(names, *ctes, f'T AS ({select})', RUNS)} {RUNS_OUT}"


def runs_of(t: T.StepTensor, digits: int | None = None) -> DataFrame:
    val = F.col("val") if digits is None else F.round(F.col("val").cast("double"), digits)
    frame = t.frame() if digits is None else t.frame().withColumn("val", val)
    return runs.canonical(frame, t.length).select(F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "val")


def add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


def on(names: str, fn: Callable[..., DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query whose tensors are the named sources."""
    return lambda spark, sf: fn(*(SOURCES[n](spark, sf) for n in names))


# Sources and sinks
for _n in SOURCES:
    add(f"rle_encode_{_n}", on(_n, runs_of), runs_sql(_n, f"SELECT pos, val FROM {_n}"))
    add(f"rle_count_{_n}", on(_n, lambda t: t.runs().agg(F.count("*").alias("n_runs"))), f"{with_(_n, f'T AS (SELECT pos, val FROM {_n})', RUNS)} SELECT count(DISTINCT g) AS n_runs FROM K")
    add(
        f"compression_ratio_{_n}",
        on(_n, lambda t: red.statistics(t).select("cells", "nonzero", "runs", F.round(F.col("cells") / (2 * F.col("runs")), 6).alias("run_ratio"), F.round(F.try_divide(F.col("cells").cast("double"), 2 * F.col("nonzero")), 6).alias("sparse_ratio"))),
        f"{with_(_n, f'T AS (SELECT pos, val FROM {_n})', RUNS)} SELECT count(*) AS cells, count(*) FILTER (WHERE val <> 0) AS nonzero, count(DISTINCT g) AS runs, round(count(*) / (2.0 * count(DISTINCT g)), 6) AS run_ratio, round(count(*) / (2.0 * nullif(count(*) FILTER (WHERE val <> 0), 0)), 6) AS sparse_ratio FROM K",
    )
    add(f"histogram_{_n}", on(_n, lambda t: red.histogram(t).select("val", F.col("n").cast("bigint").alias("n"))), f"{with_(_n)} SELECT val, count(*) AS n FROM {_n} GROUP BY val")
    add(f"sum_{_n}", on(_n, red.total), f"{with_(_n)} SELECT CAST(sum(val) AS BIGINT) AS value FROM {_n}")
    add(f"count_nonzero_{_n}", on(_n, red.count_nonzero), f"{with_(_n)} SELECT count(*) FILTER (WHERE val <> 0) AS value FROM {_n}")
    add(f"min_max_{_n}", on(_n, lambda t: t.frame().agg(F.min("val").alias("least"), F.max("val").alias("most"))), f"{with_(_n)} SELECT min(val) AS least, max(val) AS most FROM {_n}")
add("decode_D", on("D", lambda t: t.cells()), f"{with_('D')} SELECT pos, val FROM D")
add("decode_M", on("M", lambda t: t.cells()), f"{with_('M')} SELECT pos, val FROM M")
add("dumps_D", on("D", lambda t: runs.dump_blocks(t.frame(), t.length, 4096)), f"{with_('D', 'T AS (SELECT pos, val FROM D)', RUNS, f'U AS ({RUNS_OUT})')} SELECT CAST(start_pos // 4096 AS BIGINT) AS blk, string_agg(end_pos || '=>' || val, ', ' ORDER BY end_pos) AS dump FROM U GROUP BY 1")
add("constant_fill", lambda spark, sf: runs_of(T.full(spark, (7, 50), 3)), "SELECT CAST(0 AS BIGINT) AS start_pos, CAST(350 AS BIGINT) AS end_pos, 3 AS val")
add("eval_E", on("E", lambda t: runs_of((t * 3).eval() + 1)), runs_sql("E", "SELECT pos, val * 3 + 1 AS val FROM E"))

# Elementwise
add("rle_affine_D", on("D", lambda t: runs_of(t * 2 + 1)), runs_sql("D", "SELECT pos, val * 2 + 1 AS val FROM D"))
_OPS = {
    "add": (lambda a, b: a + b, "e.val + d.val"),
    "sub": (lambda a, b: a - b, "e.val - d.val"),
    "mul": (lambda a, b: a * b, "e.val * d.val"),
    "floordiv": (lambda a, b: (a - 9) // (b + 1), "(e.val - 9) // (d.val + 1)"),
    "mod": (lambda a, b: (a - 9) % (b + 1), "(e.val - 9) % (d.val + 1)"),
    "min": (lambda a, b: a.min(b), "least(e.val, d.val)"),
    "max": (lambda a, b: a.max(b), "greatest(e.val, d.val)"),
    "and": (lambda a, b: a & b, "e.val & d.val"),
    "or": (lambda a, b: a | b, "e.val | d.val"),
    "xor": (lambda a, b: a ^ b, "xor(e.val, d.val)"),
    "shl": (lambda a, b: b << a, "d.val << e.val"),
    "shr": (lambda a, b: b >> a, "d.val >> e.val"),
    "coalesce": (lambda a, b: a.coalesce(b), "CASE WHEN e.val <> 0 THEN e.val ELSE d.val END"),
    "reflected": (lambda a, b: 100 - a * b, "100 - e.val * d.val"),
}
for _k, (_f, _s) in _OPS.items():
    add(f"ew_{_k}_ED", on("ED", lambda a, b, f=_f: runs_of(f(a, b))), runs_sql("ED", f"SELECT e.pos, CAST({_s} AS INTEGER) AS val FROM E e JOIN D d USING (pos)"))
_UNARY = {
    "neg": (lambda t: -t, "-val"),
    "pos": (lambda t: +t, "val"),
    "invert": (lambda t: ~t, "~val"),
    "abs": (lambda t: abs(t - 2), "abs(val - 2)"),
    "sqrt": (lambda t: (t * 7).sqrt(), "trunc(sqrt(val * 7))"),
    "exp": (lambda t: t.exp(), "trunc(exp(val))"),
    "pow": (lambda t: t**3, "val * val * val"),
    "rpow": (lambda t: 2**t, "1 << val"),
}
for _k, (_f, _s) in _UNARY.items():
    add(f"ew_{_k}_E", on("E", lambda t, f=_f: runs_of(f(t))), runs_sql("E", f"SELECT pos, CAST({_s} AS INTEGER) AS val FROM E"))
for _k, _s in {"eq": "=", "ne": "<>", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}.items():
    add(f"cmp_{_k}_ED", on("ED", lambda a, b, k=_k: runs_of((a * 6).binary(k, b))), runs_sql("ED", f"SELECT e.pos, e.val * 6 {_s} d.val AS val FROM E e JOIN D d USING (pos)"))
add("logical_and_ED", on("ED", lambda a, b: runs_of((a > 1) & (b < 15))), runs_sql("ED", "SELECT e.pos, e.val > 1 AND d.val < 15 AS val FROM E e JOIN D d USING (pos)"))
add("logical_or_ED", on("ED", lambda a, b: runs_of((a > 3) | (b < 9))), runs_sql("ED", "SELECT e.pos, e.val > 3 OR d.val < 9 AS val FROM E e JOIN D d USING (pos)"))
add("logical_not_E", on("E", lambda t: runs_of(t.logical_not())), runs_sql("E", "SELECT pos, val = 0 AS val FROM E"))
add("select_EDO", on("EDO", lambda e, d, o: runs_of(T.where((e > 2)[: min(len(e), len(o))], d[: min(len(e), len(o))], o[: min(len(e), len(o))]))), runs_sql("EDO", "SELECT pos, CASE WHEN e.val > 2 THEN d.val ELSE o.val END AS val FROM E e JOIN D d USING (pos) JOIN O o USING (pos)"))
add("coalesce_zero_EO", on("EO", lambda e, o: runs_of(e[: min(len(e), len(o))].coalesce(o[: min(len(e), len(o))]))), runs_sql("EO", "SELECT pos, CASE WHEN e.val <> 0 THEN e.val ELSE o.val END AS val FROM E e JOIN O o USING (pos)"))
add("cast_int_E", on("E", lambda t: runs_of((t.to(float) * 1.5).to(int))), runs_sql("E", "SELECT pos, CAST(trunc(val * 1.5) AS INTEGER) AS val FROM E"))
add("cast_float_E", on("E", lambda t: runs_of(t.to(float), 4)), runs_sql("E", "SELECT pos, round(CAST(val AS DOUBLE), 4) AS val FROM E"))
add("cast_bool_E", on("E", lambda t: runs_of(t.to(bool))), runs_sql("E", "SELECT pos, val <> 0 AS val FROM E"))
add("cast_char_D", on("D", lambda t: runs_of((t * 9).to("c").to(int))), runs_sql("D", "SELECT pos, CAST((val * 9 + 128) % 256 - 128 AS INTEGER) AS val FROM D"))
add("truediv_ED", on("ED", lambda a, b: runs_of(a / b, 4)), runs_sql("ED", "SELECT e.pos, round(CAST(e.val AS DOUBLE) / d.val, 4) AS val FROM E e JOIN D d USING (pos)"))
add("fused_expr_EDD", on("ED", lambda e, d: runs_of(e * d - d % 3 + 2)), runs_sql("ED", "SELECT e.pos, CAST(e.val * d.val - d.val % 3 + 2 AS INTEGER) AS val FROM E e JOIN D d USING (pos)"))
add("map_values_ED", on("ED", lambda e, d: runs_of(T.map_values(lambda a, b: F.pmod(a * 31 + b * 17, F.lit(11)).cast("int"), e, d))), runs_sql("ED", "SELECT e.pos, CAST((e.val * 31 + d.val * 17) % 11 AS INTEGER) AS val FROM E e JOIN D d USING (pos)"))
add("masked_walk_ED", on("ED", lambda e, d: voxels.walk(e == 4, e, d)), f"{with_('ED')} SELECT e.pos, e.val AS v0, d.val AS v1 FROM E e JOIN D d USING (pos) WHERE e.val = 4")

# Slices
for _n, _p in {"E": 777, "G": 12345}.items():
    add(f"point_get_{_n}", on(_n, lambda t, p=_p: t.sliced_flat(p, p + 1).frame().select("val")), f"{with_(_n)} SELECT val FROM {_n} WHERE pos = {_p}")
add("slice1d_E", on("E", lambda t: runs_of(t[10:900:3])), runs_sql("E", "SELECT (pos - 10) // 3 AS pos, val FROM E WHERE pos >= 10 AND pos < 900 AND (pos - 10) % 3 = 0"))
add("slice_chain_E", on("E", lambda t: runs_of(t[1:901:2][3::4])), runs_sql("E", "SELECT (pos - 7) // 8 AS pos, val FROM E WHERE pos >= 7 AND pos < 901 AND (pos - 7) % 8 = 0"))
_XYZ = "X AS (SELECT pos % 7 AS x, (pos // 7) % 50 AS y, pos // 350 AS z, val FROM G)"
add("slice_nd_G", on("G", lambda t: runs_of(t[1:6:2, 5:45:3, 10:80:4])), runs_sql("G", "SELECT (x - 1) // 2 + 3 * ((y - 5) // 3) + 42 * ((z - 10) // 4) AS pos, val FROM X WHERE x BETWEEN 1 AND 5 AND (x - 1) % 2 = 0 AND y >= 5 AND y < 45 AND (y - 5) % 3 = 0 AND z >= 10 AND z < 80 AND (z - 10) % 4 = 0", _XYZ))
add("take_axis_G", on("G", lambda t: runs_of(manipulate.take(t, slice(2, 40, 2), 1))), runs_sql("G", "SELECT x + 7 * ((y - 2) // 2) + 133 * z AS pos, val FROM X WHERE y >= 2 AND y < 40 AND y % 2 = 0", _XYZ))
add("take_all_G", on("G", lambda t: runs_of(manipulate.take(t, slice(1, 7)))), runs_sql("G", "SELECT (x - 1) + 6 * (y - 1) + 36 * (z - 1) AS pos, val FROM X WHERE x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6 AND z BETWEEN 1 AND 6", _XYZ))
add("mixed_index_G", on("G", lambda t: runs_of(t[-1, 0:2, 3:5])), runs_sql("G", "SELECT y + 2 * (z - 3) AS pos, val FROM X WHERE x = 6 AND y < 2 AND z BETWEEN 3 AND 4", _XYZ))

# Sets and updates
add("set_scalar_D", on("D", lambda t: runs_of(t.set(slice(100, 5000), 77))), runs_sql("D", "SELECT pos, CASE WHEN pos >= 100 AND pos < 5000 THEN 77 ELSE val END AS val FROM D"))
add("set_strided_E", on("E", lambda t: runs_of(t.set(slice(10, 900, 3), -5))), runs_sql("E", "SELECT pos, CASE WHEN pos >= 10 AND pos < 900 AND (pos - 10) % 3 = 0 THEN -5 ELSE val END AS val FROM E"))
add("set_array_ED", on("ED", lambda e, d: runs_of(e.set(slice(5, 405, 2), d[100:300]))), runs_sql("ED", "SELECT e.pos, CASE WHEN e.pos >= 5 AND e.pos < 405 AND (e.pos - 5) % 2 = 0 THEN (SELECT d.val FROM D d WHERE d.pos = 100 + (e.pos - 5) // 2) ELSE e.val END AS val FROM E e"))
add("set_nd_G", on("G", lambda t: runs_of(t.set((slice(1, 6, 2), slice(0, 50, 7), slice(3, 60)), 999))), runs_sql("G", "SELECT pos, CASE WHEN pos % 7 IN (1, 3, 5) AND (pos // 7) % 50 % 7 = 0 AND pos // 350 BETWEEN 3 AND 59 THEN 999 ELSE val END AS val FROM G"))
add("inplace_band_G", on("G", lambda t: runs_of(t.set((slice(2, 5), slice(10, 20), slice(5, 9)), t[2:5, 10:20, 5:9] - 3))), runs_sql("G", "SELECT pos, CASE WHEN pos % 7 BETWEEN 2 AND 4 AND (pos // 7) % 50 BETWEEN 10 AND 19 AND pos // 350 BETWEEN 5 AND 8 THEN val - 3 ELSE val END AS val FROM G"))


def _updates(spark: SparkSession, sf: str) -> DataFrame:
    e = tables.table(spark, sf, "events")
    rows = e.select(F.col("event_id").alias("seq"), F.pmod(F.col("user_id") * 37, F.lit(5000)).alias("start"), tables.coded("event_type", tables.EVENT_CODES).alias("val"))
    return runs_of(T.apply_updates(rows.withColumn("end", F.col("start") + 3), 5003, -1, "i"))


add("builder_updates", _updates, runs_sql("", "SELECT r.range AS pos, CAST(coalesce(v, -1) AS INTEGER) AS val FROM range(5003) r LEFT JOIN (SELECT p, arg_max(val, event_id) AS v FROM U, LATERAL (SELECT unnest([s, s + 1, s + 2]) AS p) GROUP BY p) w ON w.p = r.range", "U AS (SELECT event_id, (user_id * 37) % 5000 AS s, CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS val FROM events)"))

# Composition
add("concat_ED", on("ED", lambda e, d: runs_of(manipulate.concat([e, d, e[:7]]))), runs_sql("ED", "SELECT pos, val FROM E UNION ALL SELECT pos + (SELECT count(*) FROM E), val FROM D UNION ALL SELECT pos + 2 * (SELECT count(*) FROM E), val FROM E WHERE pos < 7"))
add("blockdiag_G", on("G", lambda t: runs_of(manipulate.stack(t[0:2, 0:5, 0:3], t[2:7, 5:9, 10:14]))), runs_sql("G", "SELECT r.range AS pos, coalesce(val, 0) AS val FROM range(7 * 9 * 7) r LEFT JOIN (SELECT x + 7 * y + 63 * z AS p, val FROM X WHERE x < 2 AND y < 5 AND z < 3 UNION ALL SELECT x + 7 * y + 63 * (z - 7) AS p, val FROM X WHERE x >= 2 AND y BETWEEN 5 AND 8 AND z BETWEEN 10 AND 13) c ON c.p = r.range", _XYZ))
add("reshape_G", on("G", lambda t: runs_of(t.reshape(350, 84)[100:200, 1:80:2])), runs_sql("G", "SELECT (pos % 350 - 100) + 100 * ((pos // 350 - 1) // 2) AS pos, val FROM G WHERE pos % 350 BETWEEN 100 AND 199 AND pos // 350 BETWEEN 1 AND 79 AND (pos // 350 - 1) % 2 = 0"))
add("squeeze_flatten_G", on("G", lambda t: runs_of(t[3, :, :].squeeze().flatten()[10:500])), runs_sql("G", "SELECT y + 50 * z - 10 AS pos, val FROM X WHERE x = 3 AND y + 50 * z BETWEEN 10 AND 499", _XYZ))
add("pad_G", on("G", lambda t: runs_of(manipulate.pad(t, 2, -1))), runs_sql("G", "SELECT r.range AS pos, coalesce(val, -1) AS val FROM range(11 * 54 * 88) r LEFT JOIN (SELECT (x + 2) + 11 * (y + 2) + 594 * (z + 2) AS p, val FROM X) c ON c.p = r.range", _XYZ))
add("transpose_G", on("G", lambda t: runs_of(manipulate.transpose(t))), runs_sql("G", "SELECT z + 84 * y + 4200 * x AS pos, val FROM X", _XYZ))

# Reductions
for _a, (_key, _name) in enumerate((("y + 50 * z", "x"), ("x + 7 * z", "y"), ("x + 7 * y", "z"))):
    add(f"sum_axis{_a}_G", on("G", lambda t, a=_a: runs_of(red.sum_axis(t, a))), runs_sql("G", f"SELECT {_key} AS pos, CAST(sum(val) AS INTEGER) AS val FROM X GROUP BY 1", _XYZ))
add("sum_axis_keepdims_G", on("G", lambda t: runs_of(red.sum_axis(t, 1, True) * 2)), runs_sql("G", "SELECT x + 7 * z AS pos, CAST(2 * sum(val) AS INTEGER) AS val FROM X GROUP BY 1", _XYZ))
one = lambda t, value: t.spark.range(1).select(F.lit(value).alias("value"))
add("prod_D", on("D", lambda t: one(t, red.prod_(t % 5 * 2 + 1))), f"{with_('D')}, P AS (SELECT list_reduce(list(CAST(val % 5 * 2 + 1 AS BIGINT)), lambda a, b: (a * b) % 4294967296) AS p FROM D) SELECT CAST((p + 2147483648) % 4294967296 - 2147483648 AS INTEGER) AS value FROM P")
add("prod_zero_D", on("D", lambda t: one(t, red.prod_(t - 7))), f"{with_('D')} SELECT CAST(0 AS INTEGER) AS value FROM D LIMIT 1")
_STEPS = lambda t: T.where(t == 1, 2.0, T.where(t == 2, 0.5, T.where(t == 3, -1.0, (t * 0 + 1).to(float))))
add("prod_float_E", on("E", lambda t: one(t, red.prod_(_STEPS(t)))), f"{with_('E')} SELECT product(CASE val WHEN 1 THEN 2.0 WHEN 2 THEN 0.5 WHEN 3 THEN -1.0 ELSE 1.0 END) AS value FROM E")
add("prod_float_zero_E", on("E", lambda t: one(t, red.prod_(t.to(float)))), f"{with_('E')} SELECT CAST(CASE WHEN count(*) FILTER (WHERE val = 0) > 0 THEN 0 ELSE 1 END AS DOUBLE) AS value FROM E")
add("reduce_max_E", on("E", lambda t: one(t, red.reduce(lambda a, b: a.max(b), t))), f"{with_('E')} SELECT max(val) AS value FROM E")
add("reduce_axis_G", on("G", lambda t: runs_of(red.reduce(lambda a, b: a.max(b), t, 1))), runs_sql("G", "SELECT x + 7 * z AS pos, max(val) AS val FROM X GROUP BY 1", _XYZ))
# Of floats
_FLOATS = {
    "floordiv": (lambda a, b: (a - 2.5) // b, "(e.val - 2.5) / d.val"),
    "mod": (lambda a, b: (a * 7.0 - 9.5) % b, "CAST(e.val * 7.0 - 9.5 AS DOUBLE) % CAST(d.val AS DOUBLE)"),
    "min": (lambda a, b: (a * 4.0).min(b), "least(e.val * 4.0, d.val)"),
    "max": (lambda a, b: (a * 4.0).max(b), "greatest(e.val * 4.0, d.val)"),
    "pow": (lambda a, b: (b * 0.5) ** a, "pow(d.val * 0.5, e.val)"),
    "coalesce": (lambda a, b: (a * 0.5).coalesce(b), "CASE WHEN e.val <> 0 THEN e.val * 0.5 ELSE d.val END"),
}
for _k, (_f, _s) in _FLOATS.items():
    add(f"{_k}_float_ED", on("ED", lambda a, b, f=_f: runs_of(f(a.to(float), b.to(float)), 3)), runs_sql("ED", f"SELECT e.pos, round(CAST({_s} AS DOUBLE), 3) AS val FROM E e JOIN D d USING (pos)"))

# Neighbourhoods
SOBEL = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]], np.int32)
_SOBEL_TAPS = "taps(dx, dy, w) AS (VALUES (-1, -1, -1), (1, -1, 1), (-1, 0, -2), (1, 0, 2), (-1, 1, -1), (1, 1, 1))"


def sobel(t: T.StepTensor) -> T.StepTensor:
    return convolve.conv_2d(t.reshape(350, 84), SOBEL, 1)


add("conv2d_sobel_G", on("G", lambda t: runs_of(sobel(t))), runs_sql("G", f"SELECT r.range AS pos, CAST(coalesce(v, 0) AS INTEGER) AS val FROM range({CELLS}) r LEFT JOIN (SELECT (x - dx) + 350 * (y - dy) AS p, sum(val * w) AS v FROM C, taps WHERE x - dx BETWEEN 0 AND 349 AND y - dy BETWEEN 0 AND 83 GROUP BY 1) o ON o.p = r.range", "C AS (SELECT pos % 350 AS x, pos // 350 AS y, val FROM G WHERE val <> 0)", _SOBEL_TAPS))
add("conv3d_box_G", on("G", lambda t: runs_of(convolve.conv_3d(t, np.ones((3, 3, 3), np.int32)))), runs_sql("G", "SELECT (x - dx) + 5 * (y - dy) + 240 * (z - dz) AS pos, CAST(sum(val) AS INTEGER) AS val FROM X, (SELECT range AS dx FROM range(3)), (SELECT range AS dy FROM range(3)), (SELECT range AS dz FROM range(3)) WHERE x - dx BETWEEN 0 AND 4 AND y - dy BETWEEN 0 AND 47 AND z - dz BETWEEN 0 AND 81 GROUP BY 1", _XYZ))
_LINE = "(VALUES (0, 1), (1, 6), (2, 15), (3, 20), (4, 15), (5, 6), (6, 1)) v(k, w)"
_BLUR = [f"B{j} AS (SELECT {', '.join(f'b.{c} - v.k + 3 AS {c}' if c == a else f'b.{c}' for c in 'xyz')}, sum(b.val * v.w / 64.0) AS val FROM {'X' if j == 0 else f'B{j - 1}'} b, {_LINE} WHERE b.{a} - v.k + 3 BETWEEN 0 AND {n - 1} GROUP BY ALL)" for j, (a, n) in enumerate(zip("xyz", tables.GRID, strict=True))]
add("blur_G", on("G", lambda t: convolve.gaussian_blur(t).cells().select("pos", F.round(F.col("val").cast("double"), 3).alias("val"))), f"{with_('G', _XYZ, *_BLUR)} SELECT x + 7 * y + 350 * z AS pos, round(CAST(val AS DOUBLE), 3) AS val FROM B2")
add("conv2d_float_G", on("G", lambda t: convolve.conv_2d(t.reshape(350, 84).to(float), SOBEL.astype(np.float32) / 2, 1).cells().select("pos", F.round(F.col("val").cast("double"), 3).alias("val"))), f"{with_('G', 'C AS (SELECT pos % 350 AS x, pos // 350 AS y, val FROM G WHERE val <> 0)', _SOBEL_TAPS)} SELECT r.range AS pos, round(CAST(coalesce(v, 0) AS DOUBLE), 3) AS val FROM range({CELLS}) r LEFT JOIN (SELECT (x - dx) + 350 * (y - dy) AS p, sum(val * w) / 2.0 AS v FROM C, taps WHERE x - dx BETWEEN 0 AND 349 AND y - dy BETWEEN 0 AND 83 GROUP BY 1) o ON o.p = r.range")
_AROUND = "(SELECT range - 1 AS dx FROM range(3)) a, (SELECT range - 1 AS dy FROM range(3)) b, (SELECT range - 1 AS dz FROM range(3)) c WHERE x - dx BETWEEN 0 AND 6 AND y - dy BETWEEN 0 AND 49 AND z - dz BETWEEN 0 AND 83 GROUP BY 1"
add("sharpen_G", on("G", lambda t: runs_of(convolve.sharpen(t))), runs_sql("G", f"SELECT (x - dx) + 7 * (y - dy) + 350 * (z - dz) AS pos, CAST(sum(CASE WHEN dx = 0 AND dy = 0 AND dz = 0 THEN 26 ELSE -1 END * val) AS INTEGER) AS val FROM X, {_AROUND}", _XYZ))
add("box_blur_G", on("G", lambda t: convolve.box(t).cells().select("pos", F.round(F.col("val").cast("double"), 3).alias("val"))), f"{with_('G', _XYZ)} SELECT (x - dx) + 7 * (y - dy) + 350 * (z - dz) AS pos, round(sum(val) / 27.0, 3) AS val FROM X, {_AROUND}")
add("shift_and_not_E", on("E", lambda t: runs_of(t[3:] & ~t[: len(t) - 3])), runs_sql("E", "SELECT a.pos - 3 AS pos, CAST(a.val & ~b.val AS INTEGER) AS val FROM E a JOIN E b ON a.pos = b.pos + 3"))
add("shift_or_E", on("E", lambda t: runs_of(convolve.shift_or(t, 3))), runs_sql("E", "SELECT a.pos - 3 AS pos, CAST(a.val | b.val AS INTEGER) AS val FROM E a JOIN E b ON a.pos = b.pos + 3"))
add("downsample_G", on("G", lambda t: runs_of(convolve.downsample(t), 4)), runs_sql("G", "SELECT x // 2 + 4 * (y // 2) + 100 * (z // 2) AS pos, round(avg(val), 4) AS val FROM X GROUP BY 1", _XYZ))
add("highlight_runs_D", on("D", lambda t: runs_of(convolve.highlight_runs(t))), runs_sql("D", "SELECT pos, coalesce(val = lead(val) OVER (ORDER BY pos), FALSE) AS val FROM D"))

# Voxels
_NEAR = "N AS (SELECT a.pos, a.x, a.y, a.z, a.val, CAST(CASE WHEN a.val = 0 THEN 0 ELSE " + " + ".join(f"CASE WHEN coalesce(n{k}.val, 0) = 0 THEN {bit} ELSE 0 END" for k, (*_, bit) in enumerate(voxels.FACES)) + " END AS INTEGER) AS mask FROM (SELECT x + 7 * y + 350 * z AS pos, * FROM X) a " + " ".join(f"LEFT JOIN X n{k} ON n{k}.x = a.x + {side * (axis == 0)} AND n{k}.y = a.y + {side * (axis == 1)} AND n{k}.z = a.z + {side * (axis == 2)}" for k, (axis, side, _) in enumerate(voxels.FACES)) + ")"
add("adjacency_G", on("G", lambda t: runs_of(voxels.adjacency_mask(t))), runs_sql("G", "SELECT pos, mask AS val FROM N", _XYZ, _NEAR))
_FACES_SQL = "F AS (" + " UNION ALL ".join(f"SELECT x, y, z, val, {k} AS face FROM N WHERE mask & {bit} <> 0" for k, (*_, bit) in enumerate(voxels.FACES)) + ")"
add("exposed_faces_G", on("G", voxels.exposed_faces), f"{with_('G', _XYZ, _NEAR, _FACES_SQL)} SELECT x, y, z, val, face FROM F")
_QUADS = ", ".join(f"({k}, {j}, {c[0]}, {c[1]}, {c[2]})" for k, (axis, side, _) in enumerate(voxels.FACES) for j, c in enumerate(voxels._corners(axis, side)))
add("mesh_vertices_G", on("G", lambda t: voxels.mesh(t)[0].select("quad", "corner", "x", "y", "z", "val")), f"{with_('G', _XYZ, _NEAR, _FACES_SQL)} SELECT CAST(((z * 50 + y) * 7 + x) * 6 + face AS BIGINT) AS quad, corner, CAST(x + cx AS DOUBLE) AS x, CAST(y + cy AS DOUBLE) AS y, CAST(z + cz AS DOUBLE) AS z, val FROM F JOIN (VALUES {_QUADS}) q(f, corner, cx, cy, cz) ON f = face")
add("mesh_triangles_G", on("G", lambda t: voxels.mesh(t)[1]), f"{with_('G', _XYZ, _NEAR, _FACES_SQL)} SELECT CAST(((z * 50 + y) * 7 + x) * 6 + face AS BIGINT) AS quad, a, b, c FROM F, (VALUES (0, 2, 1), (3, 2, 0)) t(a, b, c)")
_CUBE = "SELECT x - cx + 6 * (y - cy) + 294 * (z - cz) AS pos, CAST(sum(CASE WHEN val >= 2.5 THEN bit ELSE 0 END) AS INTEGER) AS val FROM X, (VALUES " + ", ".join(f"({c[0]}, {c[1]}, {c[2]}, {1 << k})" for k, c in enumerate(voxels.CORNERS)) + ") c(cx, cy, cz, bit) WHERE x - cx BETWEEN 0 AND 5 AND y - cy BETWEEN 0 AND 48 AND z - cz BETWEEN 0 AND 82 GROUP BY 1"
add("mc_corner_mask_G", on("G", lambda t: runs_of(voxels.corner_mask(t, 2.5))), runs_sql("G", _CUBE, _XYZ))


def _cross(table: str, shape: tuple[int, ...], density: float) -> str:
    """Vertices where edges of the lattice cross the density."""
    w, h = shape[0], shape[0] * shape[1]
    axis = lambda k, c: f"round(a.{c} + {'(' + str(density) + ' - a.val) / (CAST(b.val AS DOUBLE) - a.val)' if 'xyz'[k] == c else '0.0'}, 5) AS {c}"
    return " UNION ALL ".join(f"SELECT CAST((a.x + {w} * a.y + {h} * a.z) * 3 + {k} AS BIGINT) AS id, {', '.join(axis(k, c) for c in 'xyz')} FROM {table} a JOIN {table} b ON b.x = a.x + {int(k == 0)} AND b.y = a.y + {int(k == 1)} AND b.z = a.z + {int(k == 2)} WHERE (a.val >= {density}) <> (b.val >= {density})" for k in range(3))


def _points(vertices: DataFrame) -> DataFrame:
    return vertices.select("id", *(F.round(c, 5).alias(c) for c in "xyz"))


add("mc_vertices_G", on("G", lambda t: _points(voxels.marching_cubes(t, 2.5)[0])), f"{with_('G', _XYZ)} {_cross('X', tables.GRID, 2.5)}")
_TRIANGLES = ", ".join(f"({case}, {', '.join(str((c & 1) + 7 * (c >> 1 & 1) + 350 * (c >> 2)) + ', ' + str(axis) for c, axis in tri)})" for case in range(1, 255) for tri in voxels.case_triangles(case))
add("marching_cubes_G", on("G", lambda t: voxels.marching_cubes(t, 2.5)[1]), f"{with_('G', _XYZ, f'Q AS ({_CUBE})')} SELECT " + ", ".join(f"CAST((p + s{k}) * 3 + x{k} AS BIGINT) AS {c}" for k, c in enumerate("abc")) + f" FROM (SELECT val, pos % 6 + 7 * ((pos // 6) % 49) + 350 * (pos // 294) AS p FROM Q) q JOIN (VALUES {_TRIANGLES}) t(v, s0, x0, s1, x1, s2, x2) ON v = val")
_LATTICE = "L AS (SELECT x + dx AS x, y + dy AS y, z + dz AS z, sum(val) / 8.0 AS val FROM X, (SELECT range AS dx FROM range(2)) a, (SELECT range AS dy FROM range(2)) b, (SELECT range AS dz FROM range(2)) c GROUP BY ALL)"
add("isosurface_G", on("G", lambda t: _points(voxels.isosurface(t, 1.3)[0])), f"{with_('G', _XYZ, _LATTICE)} {_cross('L', (8, 51, 85), 1.3)}")
add("topdown_map_G", on("G", lambda t: voxels.topdown(t)), f"{with_('G', _XYZ)} SELECT x AS a, z AS b, arg_max(val, y) AS val, max(y) AS height FROM X WHERE val <> 0 GROUP BY x, z")
add("bounding_box_G", on("G", voxels.bounding_box), f"{with_('G', _XYZ)} SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM X WHERE val <> 0")
_ORDERS = " UNION ALL ".join(
    f"SELECT '{o}' AS \"order\", CAST(sum(brk) AS BIGINT) AS runs, {CELLS} / (2.0 * CAST(sum(brk) AS BIGINT)) AS ratio FROM (SELECT CASE WHEN val IS DISTINCT FROM lag(val) OVER (ORDER BY {o[2]}, {o[1]}, {o[0]}) THEN 1 ELSE 0 END AS brk FROM X)" for o in ("xyz", "xzy", "yxz", "yzx", "zxy", "zyx")
)
add("column_order_G", on("G", lambda t: voxels.column_orders(t).withColumn("ratio", F.round("ratio", 6))), f"{with_('G', _XYZ)} SELECT \"order\", runs, round(ratio, 6) AS ratio FROM ({_ORDERS})")
add("pack_rgba", lambda spark, sf: tables.table(spark, sf, "part").select("p_partkey", scalar.pack_rgba(*(F.pmod(F.col("p_partkey") * k, F.lit(256)) for k in (1, 3, 7, 11))).alias("rgba")), "SELECT p_partkey, CAST((p_partkey % 256) + ((p_partkey * 3) % 256) * 256 + ((p_partkey * 7) % 256) * 65536 + ((p_partkey * 11) % 256) * 16777216 AS BIGINT) AS rgba FROM part")
add("color_join_G", on("G", lambda t: red.histogram(t).join(voxels.color_config(t.spark, {1: (9, 8, 7, 255), 2: (1, 2, 3, 255), 3: (4, 5, 6, 128)}), "val").select("val", F.col("n").cast("bigint").alias("n"), "r", "g", "b", "a")), f"{with_('G')} SELECT val, count(*) AS n, r, g, b, a FROM G JOIN (VALUES (1, 9, 8, 7, 255), (2, 1, 2, 3, 255), (3, 4, 5, 6, 128)) c(v, r, g, b, a) ON v = val GROUP BY ALL")


def _synthetic(spark: SparkSession, sf: str) -> DataFrame:
    a, b = (synthetic.run_length_array(spark, 200_000, 20_000, 100, True, s) for s in (1, 2))
    return runs_of(a + b)


def _drawn(name: str, seed: int, stream: int) -> str:
    """The generator's draws of 200 rows, step by step."""
    u, m = f"SELECT id, (id * 7919 + {seed * 104729 + stream * 1299709 + 12345}) % {synthetic.PRIME} AS u FROM (SELECT range AS id FROM range(200))", synthetic.PRIME
    for f in synthetic.FACTORS:
        u = f"SELECT id, u * u % {m} AS u FROM (SELECT id, (u * {f} + id) % {m} AS u FROM ({u}))"
    return f"{name} AS ({u})"


def _run_array(name: str, seed: int) -> list[str]:
    cells = f"SELECT s.u % 200000 + k.range AS pos, arg_max(v.u % 32768, s.id) AS val FROM {name}s s JOIN {name}v v USING (id), range(100) k WHERE s.u % 200000 + k.range < 200000 GROUP BY 1"
    return [_drawn(f"{name}s", seed, 0), _drawn(f"{name}v", seed, 1), f"{name} AS ({cells})"]


add("synthetic_runs_add", _synthetic, runs_sql("", "SELECT r.range AS pos, CAST(coalesce(A1.val, 0) + coalesce(A2.val, 0) AS INTEGER) AS val FROM range(200000) r LEFT JOIN A1 ON A1.pos = r.range LEFT JOIN A2 ON A2.pos = r.range", *_run_array("A1", 1), *_run_array("A2", 2)))


# Builders, points, levels, assembly, colours
def _built_points(t: T.StepTensor) -> DataFrame:
    b = T.builder(t.spark, len(t), -1)
    for k in range(60):
        b[k * k * 37 % len(t)] = k
    return runs_of(b.build())


def _built_boxes(t: T.StepTensor) -> DataFrame:
    b = T.builder(t.spark, t.shape, 0)
    b[1:5, 10:40, 3:60] = 7
    b[2:4, 0:50, 50:84] = t[2:4, 0:50, 50:84]
    b[0:1, 5:6, 0:84] = -2
    b[3, 20, 55] = 99
    b[6, :, 7] = 5
    return runs_of(b.build())


add("point_set_E", on("E", lambda t: runs_of(t.set(777, 42))), runs_sql("E", "SELECT pos, CASE WHEN pos = 777 THEN 42 ELSE val END AS val FROM E"))
add("builder_points_E", on("E", _built_points), runs_sql("E", "SELECT e.pos, CAST(coalesce(k, -1) AS INTEGER) AS val FROM E e LEFT JOIN (SELECT (range * range * 37) % (SELECT count(*) FROM E) AS p, max(range) AS k FROM range(60) GROUP BY 1) b ON b.p = e.pos"))
add("builder_boxes_G", on("G", _built_boxes), runs_sql("G", "SELECT x + 7 * y + 350 * z AS pos, CASE WHEN x = 6 AND z = 7 THEN 5 WHEN x = 3 AND y = 20 AND z = 55 THEN 99 WHEN x = 0 AND y = 5 THEN -2 WHEN x BETWEEN 2 AND 3 AND z >= 50 THEN val WHEN x BETWEEN 1 AND 4 AND y BETWEEN 10 AND 39 AND z BETWEEN 3 AND 59 THEN 7 ELSE 0 END AS val FROM X", _XYZ))


def _built_row(spark: SparkSession, sf: str) -> DataFrame:
    b = T.builder(spark, (1, 6), 0)
    b[0, 1:5] = 9
    b[0, 2:3] = T.from_list(spark, [4])
    return runs_of(b.build())


add("builder_leading_one", _built_row, "SELECT CAST(s AS BIGINT) AS start_pos, CAST(e AS BIGINT) AS end_pos, v AS val FROM (VALUES (0, 1, 0), (1, 2, 9), (2, 3, 4), (3, 5, 9), (5, 6, 0)) t(s, e, v)")
add("from_numpy", lambda spark, sf: runs_of(T.from_numpy(spark, np.arange(120).reshape(10, 12) // 7 % 4)), runs_sql("", "SELECT range AS pos, CAST(range // 7 % 4 AS INTEGER) AS val FROM range(120)", "N AS (SELECT 1)"))


def _level(t: T.StepTensor) -> DataFrame:
    path = config.fresh_path(t.spark, "level")
    levels.dump(t, path)
    return runs_of(levels.load(t.spark, path))


def _assembled(t: T.StepTensor) -> DataFrame:
    """The grid cut into blocks of 7 x 10 x 12 cells and put together again."""
    x, y, z = voxels.coordinates(F.col("pos"), t.shape)
    low = [F.lit(0).cast("bigint"), y - y % 10, z - z % 12]
    inner = x + 7 * (y % 10) + 70 * (z % 12)
    cells = t.cells().select(*(c.alias(n) for c, n in zip(low, ("cx", "cy", "cz"), strict=True)), inner.alias("start"), (inner + 1).alias("end"), "val")
    return runs_of(manipulate.assemble(cells, (7, 10, 12), t.shape))


add("level_G", on("G", _level), runs_sql("G", "SELECT pos, val FROM G"))
add("assembly_G", on("G", _assembled), runs_sql("G", "SELECT pos, val FROM G"))
add("unpack_rgba", lambda spark, sf: tables.table(spark, sf, "part").select("p_partkey", *(c.alias(n) for c, n in zip(scalar.unpack_rgba(F.col("p_partkey") * 7919), "rgba", strict=True))), "SELECT p_partkey, " + ", ".join(f"CAST((p_partkey * 7919 >> {8 * k}) & 255 AS INTEGER) AS {c}" for k, c in enumerate("rgba")) + " FROM part")
_HUE = "SELECT p_partkey, h, 0.6 AS c, 0.6 * (1 - abs(h % 2 - 1)) AS s FROM (SELECT p_partkey, ((p_partkey * 0.6180339887498949::DOUBLE) % 1.0) * 6 AS h FROM part)"
_PICK = {"r": "csoosc", "g": "sccsoo", "b": "oosccs"}
add("hue_colors", lambda spark, sf: voxels.hue_colors(tables.table(spark, sf, "part").select("p_partkey"), "p_partkey"), "SELECT p_partkey, " + ", ".join(f"CAST(round((CASE CAST(floor(h) AS INTEGER) " + " ".join(f"WHEN {k} THEN {'0.0' if q == 'o' else q}" for k, q in enumerate(order)) + f" END + 0.2) * 255) AS INTEGER) AS {c}" for c, order in _PICK.items()) + f", 255 AS a FROM ({_HUE})")
add("flagship", on("G", lambda t: runs_of(sobel(t))), ORACLE_SQL["conv2d_sobel_G"])
