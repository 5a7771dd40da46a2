"""One query for each operator over lattice views of the tables, with DuckDB SQL for the same rows.

Values are rounded to six decimals on both sides; ``+ 0.0`` turns a negative zero into zero.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.lattice import Lattice
from gridloom.operators import mesh, reduce, temporal, tensor
from gridloom.sources import bitmap, nifti, views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

E4 = """e as (select cast(i % 4 as int) as x, cast((i // 4) % 4 as int) as y, cast(i // 16 as int) as z, cast(vec_id as int) as t, v
  from (select vec_id, unnest(range(0, 64)) as i, cast(unnest(embedding) as double) as v from embeddings))"""
E3 = """e as (select cast(i % 8 as int) as x, cast(i // 8 as int) as y, cast(vec_id as int) as z, 0 as t, v
  from (select vec_id, unnest(range(0, 64)) as i, cast(unnest(embedding) as double) as v from embeddings))"""
VIEWS = {"4": (views.emb4d, E4), "3": (views.emb3d, E3)}


def rows(lat: Lattice) -> DataFrame:
    return lat.df.select("x", "y", "z", "t", (F.round(F.col("v").cast("double"), 6) + 0.0).alias("v"))


def add(name: str, view: str, f: Callable[[Lattice], Lattice], sql: str | None = None, out: Callable | None = None) -> None:
    """Register ``f`` over a view. ``sql`` is the rest of a query that begins with the view as ``e``."""
    source, head = VIEWS[view]
    QUERIES[name] = lambda spark, d: (out or rows)(f(source(spark, d)))
    if sql is not None:
        ORACLES[name] = f"with {head}{sql}"


def each(expr: str, source: str = "e") -> str:
    return f" select x, y, z, t, round({expr}, 6) + 0.0 as v from {source}"


# pointwise, on values times ten
TEN = lambda lat: lat.mul(10)
V = "(v * 10)"
NANS = f"case when {V} < 0 then cast('nan' as double) else sqrt(abs({V})) end"
for _name, _sql in {
    "exp": f"exp({V})", "log": f"case when {V} <= 0 then 0 else ln(abs({V}) + (case when v = 0 then 1 else 0 end)) end",
    "floor": f"floor({V})", "ceil": f"ceil({V})", "trunc": f"trunc({V})", "round": f"sign({V}) * floor(abs({V}) + 0.5)",
    "sin": f"sin({V})", "cos": f"cos({V})", "tan": f"tan({V})", "atan": f"atan({V})", "sqr": f"{V} * {V}",
    "recip": f"case when v = 0 then 0 else 1 / {V} end", "abs": f"abs({V})",
    "bin": f"case when {V} > 0 then 1.0 else 0.0 end", "binv": f"case when {V} > 0 then 0.0 else 1.0 end",
    "h2c": None, "c2h": None,
}.items():
    if _sql:
        add(_name, "4", (lambda n: lambda lat: TEN(lat).apply(n))(_name), each(_sql))
add("asin", "4", lambda lat: lat.asin(), each("asin(v)"))
add("acos", "4", lambda lat: lat.acos(), each("acos(v)"))
add("sqrt", "4", lambda lat: lat.abs().sqrt(), each("sqrt(abs(v))"))
add("nan", "4", lambda lat: TEN(lat).sqrt().nan(), each(f"case when {V} < 0 then 0 else sqrt(abs({V})) end"))
add("nanm", "4", lambda lat: TEN(lat).sqrt().nanm(), each("case when v < 0 then 1.0 else 0.0 end"))
_CT = "(v * 3000)"
_UP = f"(greatest({_CT}, -1000) + 1000)"
add("h2c", "4", lambda lat: lat.mul(3000).h2c(), each(f"{_UP} + least(greatest({_UP} - 900, 0), 200) * 9"))
add("c2h", "4", lambda lat: lat.mul(3000).c2h(), each(f"{_CT} - 1000 - least(greatest({_CT} - 900, 0), 2000) / 10 * 9"))
for _name, _arg, _sql in (
    ("add", 2.5, "v + 2.5"), ("sub", 2.5, "v - 2.5"), ("mul", 2.5, "v * 2.5"), ("div", 4, "v / 4"),
    ("rem", 0.1, "trunc(fmod(v, 0.1))"), ("mod", 0.1, None), ("power", 2, "pow(v, 2)"),
    ("max_scalar", 0.1, "greatest(v, 0.1)"), ("min_scalar", 0.1, "least(v, 0.1)"),
    ("thr", 0.1, "case when v < 0.1 then 0 else v end"), ("uthr", 0.1, "case when v > 0.1 then 0 else v end"),
):
    add(_name, "4", (lambda n, a: lambda lat: lat.apply(n, a))(_name.removesuffix("_scalar"), _arg), each(_sql) if _sql and _name != "rem" else None)
ORACLES["mod"] = f"with {E4}" + each("sign(v) * (abs(v) % cast(0.1 as double))")
ORACLES["rem"] = f"with {E4}" + each("sign(v * 10) * trunc(abs(v * 10) % cast(3 as double))")
QUERIES["rem"] = lambda spark, d: rows(views.emb4d(spark, d).mul(10).rem(3))
add("roi", "4", lambda lat: lat.roi(1, 2, 0, 3, 1, -1, 5, 40), each("case when x between 1 and 2 and y between 0 and 2 and t between 5 and 44 then v else 0 end"))
add("grid", "4", lambda lat: lat.grid(9, 2), each("case when x % 2 = 0 or y % 2 = 0 or z % 2 = 0 then 9 else v end"))
add("index", "4", lambda lat: lat.thr(0).index(), """, n as (select *, case when v > 0 then 1 else 0 end as s from e)
  select x, y, z, t, round(case when s = 1 then sum(s) over (order by t, z, y, 3 - x) - 1 else 0 end, 6) + 0.0 as v from n""")  # fmt: skip
for _name in ("ztop", "ztopc"):
    add(_name, "4", (lambda n: lambda lat: TEN(lat).apply(n))(_name))
for _name in ("ptoz", "ptozc"):
    add(_name, "4", (lambda n: lambda lat: lat.abs().apply(n))(_name))
add("rand", "4", lambda lat: lat.seed(7).rand())
add("randn", "4", lambda lat: lat.seed(7).randn())
add("odt_short", "4", lambda lat: lat.mul(1e5).odt("short"), each("greatest(-32768, least(32767, sign(v) * floor(abs(v * 1e5) + 0.5)))"))
add("odt_char", "4", lambda lat: lat.mul(500).odt("char"), each("greatest(0, least(255, sign(v) * floor(abs(v * 500) + 0.5)))"))
add("odt_float", "4", lambda lat: lat.mul(1.1).odt("float"), each("cast(cast(v * 1.1 as float) as double)"))

# global statistics
_RANGE = """, u as (select v from e where {use}), st as (select min(v) as mn, max(v) as mx, count(*) as n from u),
  h as (select cast(floor((v - mn) * (1000.0 / (mx - mn)) + 0.5) as int) as b, count(*) as c from u, st group by 1),
  k as (select b, sum(c) over (order by b) as up, sum(c) over (order by b desc) as down from h),
  r as (select (select min(b) from k, st where up >= floor(n * 0.02 + 0.5)) / (1000.0 / (mx - mn)) + mn as lo,
    (select max(b) from k, st where down >= floor(n * 0.02 + 0.5)) / (1000.0 / (mx - mn)) + mn as hi from st)"""
_ALL, _SOME = _RANGE.format(use="true"), _RANGE.format(use="v <> 0")
QUERIES["robust_range"] = lambda spark, d: reduce.robust_range(views.emb4d(spark, d)).select(*(F.round(c, 6).alias(c) for c in ("lo", "hi")))
ORACLES["robust_range"] = f"with {E4}{_ALL} select round(lo, 6) as lo, round(hi, 6) as hi from r"
for _name, _cmp, _to in (("thrp", "<", "0"), ("thrP", "<", "0"), ("uthrp", ">", "0"), ("uthrP", ">", "0"), ("clamp", "<", None), ("uclamp", ">", None)):
    _thr = "(lo + (hi - lo) * 0.3)"
    _r, _pre = (_SOME, "thr") if _name.endswith("P") else (_ALL, None)
    _x = "(case when v < 0.05 then 0 else v end)" if _pre else "v"
    add(_name, "4", (lambda n, p: lambda lat: (lat.thr(0.05) if p else lat).apply(n, 30))(_name, _pre),
        (_SOME.replace("from e where", "from (select case when v < 0.05 then 0 else v end as v from e) q where") if _pre else _ALL) + each(f"case when {_x} {_cmp} {_thr} then {_to or _thr} else {_x} end", "e, r"))
add("range", "4", lambda lat: lat.range(), " select round(min(v), 6) as cal_min, round(max(v), 6) as cal_max from e",
    lambda lat: lat.df.sparkSession.createDataFrame([(round(lat.fields()["cal_min"], 6), round(lat.fields()["cal_max"], 6))], "cal_min double, cal_max double"))
add("scale01", "4", lambda lat: lat.scale01(), ", s as (select min(v) as mn, max(v) as mx from e)" + each("(v - mn) / (mx - mn)", "e, s"))
add("inm", "4", lambda lat: lat.inm(100), " select x, y, z, t, round(v * 100 / avg(case when v > 0 then v end) over (partition by t), 6) + 0.0 as v from e")
add("ing", "4", lambda lat: lat.ing(100), ", s as (select avg(case when v > 0 then v end) as m from e)" + each("v * 100 / m", "e, s"))
add("otsu", "4", lambda lat: lat.otsu(3))
add("fdr", "4", lambda lat: lat.abs().mul(0.5).fdr(0.2), """, p as (select x, y, z, t, abs(v) * 0.5 as v from e), g as (select v, count(*) as c from p group by v),
  r as (select v, sum(c) over (order by v) as i, sum(c) over () as n from g), k as (select max(case when v <= i * 0.2 / n then v end) as cut from r)""" + each("case when cut is not null and v <= cut then v else 1 end", "p, k"))  # fmt: skip
QUERIES["compare"] = lambda spark, d: reduce.compare((a := views.emb4d(spark, d)), a.mul(1.01)).select(
    "voxels", F.round("r", 6).alias("r"), F.round("max_diff", 6).alias("max_diff"), F.round("mean_a", 6).alias("mean_a"), F.round("sd_b", 6).alias("sd_b"))
ORACLES["compare"] = f"with {E4} select count(*) as voxels, round(corr(v, v * 1.01), 6) as r, round(max(abs(v - v * 1.01)), 6) as max_diff, round(avg(v), 6) as mean_a, round(stddev_samp(v * 1.01), 6) as sd_b from e"

# image with image: the other one is the same image a volume later (4-D) or volume 0 (3-D)
_B = {"add": "v + w", "sub": "v - w", "mul": "v * w", "div": "case when w = 0 then 0 else v / w end",
      "mas": "case when w > 0 then v else 0 end", "max": "greatest(v, w)", "min": "least(v, w)",
      "mod": "case when w = 0 then 0 else sign(v) * (abs(v) % abs(w)) end",
      "rem": "case when trunc(w * 20) = 0 then v * 20 else sign(v) * (abs(trunc(v * 20)) % abs(trunc(w * 20))) end"}


def _first(lat: Lattice) -> Lattice:
    return lat.crop(0, 1)


def _backwards(lat: Lattice) -> Lattice:
    return lat.with_df(lat.df.withColumn("t", F.lit(lat.shape[3] - 1) - F.col("t")))


for _name, _sql in _B.items():
    _k = 20 if _name == "rem" else 1
    add(f"{_name}_img" if _name != "mas" else "mas", "4", (lambda n, k: lambda lat: lat.mul(k).apply(n, _backwards(lat.mul(k))))(_name, _k),
        ", j as (select a.x, a.y, a.z, a.t, a.v, b.v as w from e a join e b on a.x = b.x and a.y = b.y and a.z = b.z and b.t = (select max(t) from e) - a.t)" + each(_sql, "j"))
    add(f"{_name}_img_3d", "4", (lambda n, k: lambda lat: lat.mul(k).apply(n, _first(lat.mul(k))))(_name, _k),
        ", j as (select a.x, a.y, a.z, a.t, a.v, b.v as w from e a join e b on a.x = b.x and a.y = b.y and a.z = b.z and b.t = 0)" + each(_sql, "j"))

# reductions
_AGG = {
    "mean": "avg(v)", "std": "stddev_samp(v)", "max": "max(v)", "min": "min(v)", "sum": "sum(v)",
    "maxn": "arg_min({a}, (-v, {a}))", "median": "list_sort(list(v))[cast(floor({n} * 0.5) as int) + 1]",
    "perc": "list_sort(list(v))[least(cast(floor({n} * 30 / 100.0) as int), {n} - 1) + 1]",
}
for _flag, _a in reduce.AXES.items():
    _keys = [c for c in "xyzt" if c != _a]
    _cols = ", ".join(f"0 as {c}" if c == _a else c for c in "xyzt")
    for _what, _sql in _AGG.items():
        _n = "count(*)" if _a == "t" else "4"
        if _what == "maxn":
            _sql = "min(case when v = mx then {a} end)"
        _src = f"(select *, max(v) over (partition by {', '.join(_keys)}) as mx from e) q" if _what == "maxn" else "e"
        add(f"{_flag}{_what}", "4", (lambda n: lambda lat: lat.apply(n, *([30] if n.endswith("perc") else [])))(_flag + _what),
            f" select {_cols}, round({_sql.format(a=_a, n=_n)}, 6) + 0.0 as v from {_src} group by {', '.join(_keys)}")
    _part = f"partition by {', '.join(_keys)}"
    add(f"{_flag}ar1", "4", (lambda n: lambda lat: lat.apply(n))(f"{_flag}ar1"),
        f", d as (select *, v - avg(v) over ({_part}) as d from e), l as (select *, lag(d) over ({_part} order by {_a}) as p from d) select {_cols}, round(sum(d * p) / sum(d * d), 6) + 0.0 as v from l group by {', '.join(_keys)}")

# along time
_S = "partition by x, y, z"
add("demean", "4", lambda lat: lat.demean(), each(f"v - avg(v) over ({_S})"))
add("detrend", "4", lambda lat: lat.detrend(), ", m as (select x, y, z, regr_slope(v, t) as b, regr_intercept(v, t) as a from e group by x, y, z) select x, y, z, t, round(v - (a + b * t), 6) + 0.0 as v from e join m using (x, y, z)")
add("rank", "4", lambda lat: lat.rank(), f" select x, y, z, t, row_number() over ({_S} order by v, t) + 0.0 as v from e")
add("ranknorm", "4", lambda lat: lat.ranknorm())
add("crop", "4", lambda lat: lat.crop(3, 20), " select x, y, z, t - 3 as t, round(v, 6) + 0.0 as v from e where t between 3 and 22")
for _name, _mean in (("bptf", True), ("bptfm", False)):
    _end = f"o - avg(o) over ({_S})" if _mean else "o"
    add(_name, "4", (lambda n: lambda lat: lat.apply(n, 4, 1.2))(_name), f"""
  , p as (select a.x, a.y, a.z, a.t, a.v, b.t - a.t as k, b.v as u, exp(-pow(b.t - a.t, 2) / 32.0) as w
    from e a join e b on a.x = b.x and a.y = b.y and a.z = b.z and abs(b.t - a.t) <= 12),
  m as (select x, y, z, t, any_value(v) as v, sum(w) as s0, sum(w * k) as s1, sum(w * k * k) as s2, sum(w * u) as sy, sum(w * k * u) as sxy from p group by x, y, z, t),
  h as (select x, y, z, t, v - (sy - (s0 * sxy - s1 * sy) / (s0 * s2 - s1 * s1) * s1) / s0 as o from m), d as (select x, y, z, t, {_end} as o from h)
  select a.x, a.y, a.z, a.t, round(sum(exp(-pow(b.t - a.t, 2) / 2.88) * b.o) / sum(exp(-pow(b.t - a.t, 2) / 2.88)), 6) + 0.0 as v
  from d a join d b on a.x = b.x and a.y = b.y and a.z = b.z and abs(b.t - a.t) <= 26 group by a.x, a.y, a.z, a.t""")  # fmt: skip
add("bandpass", "4", lambda lat: lat.bandpass(0.2, 0.02, 1))
add("pval", "4", lambda lat: lat.pval(), " select x, y, z, 0 as t, round(avg(case when v >= v0 then 1.0 else 0.0 end), 6) + 0.0 as v from e join (select x, y, z, v as v0 from e where t = 0) using (x, y, z) group by x, y, z")
add("pval0", "4", lambda lat: lat.thr(0).pval0(), """, p as (select x, y, z, t, case when v < 0 then 0 else v end as v from e)
  select x, y, z, 0 as t, round(case when max(v) = min(v) then 0 when min(v0) = 0 then 1 else sum(case when v >= v0 and v <> 0 then 1.0 else 0.0 end) / sum(case when v <> 0 then 1 else 0 end) end, 6) + 0.0 as v
  from p join (select x, y, z, v as v0 from p where t = 0) using (x, y, z) group by x, y, z""")  # fmt: skip
add("cpval", "4", lambda lat: lat.mul(2).cpval(), ", m as (select t, max(v) as m from e where t > 0 group by t) select x, y, z, 0 as t, round((1 + (select count(*) from m where m.m >= e.v)) / cast((select count(distinct t) from e) as double), 6) + 0.0 as v from e where t = 0")
QUERIES["roc"] = lambda spark, d: temporal.roc((a := views.emb4d(spark, d).crop(0, 1)), views.emb4d(spark, d).crop(1, 1).with_df(views.emb4d(spark, d).crop(1, 1).bin().df)).select(*(F.round(c, 6).alias(c) for c in ("fp", "tp", "threshold")))
ORACLES["roc"] = f"""with {E4}, j as (select a.v, b.v > 0 as truth from e a join e b on a.x = b.x and a.y = b.y and a.z = b.z and a.t = 0 and b.t = 1)
  select distinct round(sum(case when truth then 0.0 else 1.0 end) over (order by v desc) / sum(case when truth then 0 else 1 end) over (), 6) as fp,
  round(sum(case when truth then 1.0 else 0.0 end) over (order by v desc) / sum(case when truth then 1 else 0 end) over (), 6) as tp, round(v, 6) as threshold from j"""
# nine decimals: with six, means over 64 events end in ties that either engine may round up
QUERIES["event_demean"] = lambda spark, d: views.event_series(spark, d).demean().df.select("x", "y", "z", "t", (F.round("v", 9) + 0.0).alias("v"))
ORACLES["event_demean"] = """with s as (select user_id, value as v, row_number() over (partition by user_id order by ts, event_id) - 1 as t from events),
  u as (select user_id, row_number() over (order by user_id) - 1 as x from (select distinct user_id from events))
  select cast(x as int) as x, 0 as y, 0 as z, cast(t as int) as t, round(v - avg(v) over (partition by x), 9) + 0.0 as v from s join u using (user_id)"""

# neighbourhoods
_NB = """, j as (select a.x, a.y, a.z, a.t, a.v as own, b.v, b.x - a.x as dx, b.y - a.y as dy, b.z - a.z as dz from e a join e b
  on b.x - a.x between {0} and {1} and b.y - a.y between {2} and {3} and b.z between a.z + {4} and a.z + {5} and b.t = a.t{6})"""
_GROUP = " from j group by x, y, z, t"


def near(lo_x, hi_x, lo_y, hi_y, lo_z, hi_z, expr: str, more: str = "", pre: str = "") -> str:
    return pre + _NB.format(lo_x, hi_x, lo_y, hi_y, lo_z, hi_z, more) + f" select x, y, z, t, round({expr}, 6) + 0.0 as v{_GROUP}"


CUBE = (-1, 1, -1, 1, -1, 1)
_POS = ", e0 as (select * from e)"
add("kernel_3d", "3", lambda lat: lat.kernel("3D").fmean(), near(*CUBE, "avg(v)"))
add("kernel_2d", "3", lambda lat: lat.kernel("2D").fmean(), near(-1, 1, -1, 1, 0, 0, "avg(v)"))
add("kernel_box", "3", lambda lat: lat.kernel("box", 2).fmean(), near(-2, 2, -2, 2, -2, 2, "avg(v)"))
add("kernel_boxv", "3", lambda lat: lat.kernel("boxv", 5).dilM(), near(-2, 2, -2, 2, -2, 2, "case when any_value(own) <> 0 then any_value(own) else coalesce(avg(case when v <> 0 then v end), 0) end"))
add("kernel_boxv3", "3", lambda lat: lat.kernel("boxv3", 3, 1, 5).fmean(), near(-1, 1, 0, 0, -2, 2, "avg(v)"))
add("kernel_sphere", "3", lambda lat: lat.kernel("sphere", 2).fmean(), near(-2, 2, -2, 2, -2, 2, "avg(v)", " and pow(b.x - a.x, 2) + pow(b.y - a.y, 2) + pow(b.z - a.z, 2) <= 4"))
_G = "exp(-(dx * dx + dy * dy + dz * dz) / 0.5)"
add("kernel_gauss", "3", lambda lat: lat.kernel("gauss", 0.5).fmean(), near(-3, 3, -3, 3, -3, 3, f"sum(v * {_G}) / sum({_G})"))
add("kernel_file", "3", lambda lat: lat.kernel("file", Lattice.of_numpy(lat.df.sparkSession, np.array([[[0, 1, 0], [1, 2, 1], [0, 1, 0]]]))).fmean(),
    near(-1, 1, -1, 1, 0, 0, "sum(v * (case when dx = 0 and dy = 0 then 2 else 1 end)) / sum(case when dx = 0 and dy = 0 then 2 else 1 end)", " and abs(b.x - a.x) + abs(b.y - a.y) <= 1"))
_THR = "(select x, y, z, t, case when v < 0.05 then 0 else v end as v from e)"
_E3T = E3.replace("e as (", "e9 as (", 1)


def thresholded(sql: str) -> str:
    """The same over the values with those below 0.05 zeroed."""
    return f"with {_E3T}, e as (select x, y, z, t, case when v < 0.05 then 0 else v end as v from e9)" + sql


for _name, _sql in {
    "dilM": "case when any_value(own) <> 0 then any_value(own) else coalesce(avg(case when v <> 0 then v end), 0) end",
    "dilF": "max(v)", "eroF": "min(v)", "ero": "case when min(abs(v)) = 0 then 0 else any_value(own) end",
    "fmedian": "list_sort(list(v))[cast(floor(count(*) * 0.5) as int) + 1]", "fmean": "avg(v)", "fmeanu": "sum(v)",
}.items():
    add(_name, "3", (lambda n: lambda lat: lat.thr(0.05).apply(n))(_name))
    ORACLES[_name] = thresholded(near(*CUBE, _sql))
add("dilD", "3", lambda lat: lat.mul(20).trunc().dilD())
ORACLES["dilD"] = f"""with {_E3T}, e as (select x, y, z, t, trunc(v * 20) as v from e9){_NB.format(*CUBE, "")},
  c as (select x, y, z, t, v, count(*) as n from j where v <> 0 group by x, y, z, t, v), m as (select x, y, z, t, v, row_number() over (partition by x, y, z, t order by n desc, v desc) as k from c)
  select e.x, e.y, e.z, e.t, round(case when e.v <> 0 then e.v else coalesce(m.v, 0) end, 6) + 0.0 as v from e left join m on m.k = 1 and m.x = e.x and m.y = e.y and m.z = e.z and m.t = e.t"""
add("dilall", "3", lambda lat: lat.thr(0.3).dilall())
_SIDE = " left join e {0}l on {0}l.{0} = a.{0} - 1 and {1} left join e {0}r on {0}r.{0} = a.{0} + 1 and {2}"
_SIX = "".join(_SIDE.format(c, " and ".join(f"{c}l.{k} = a.{k}" for k in "xyz" if k != c), " and ".join(f"{c}r.{k} = a.{k}" for k in "xyz" if k != c)) for c in "xyz")
_INNER = "xl.v is not null and xr.v is not null and yl.v is not null and yr.v is not null and zl.v is not null and zr.v is not null"
add("edge", "3", lambda lat: lat.edge(), f" select a.x, a.y, a.z, a.t, round(case when {_INNER} then sqrt(pow(xr.v - xl.v, 2) + pow(yr.v - yl.v, 2) + pow(zr.v - zl.v, 2)) / (2 * sqrt(3)) else a.v end, 6) + 0.0 as v from e a{_SIX}")
_SOB = "sqrt(pow(sum(case when dz = 0 and dx <> 0 then v * dx * (2 - abs(dy)) else 0 end), 2) + pow(sum(case when dz = 0 and dy <> 0 then v * dy * (2 - abs(dx)) else 0 end), 2) + pow(sum(case when dy = 0 and dz <> 0 then v * dz * (2 - abs(dx)) else 0 end), 2))"
add("sobel", "3", lambda lat: lat.sobel(), near(*CUBE, _SOB))
add("sobel_binary", "3", lambda lat: lat.sobel_binary())
add("edginess", "3", lambda lat: lat.edginess(), f"""
  , g as (select a.x, a.y, a.z, a.t, case when {_INNER} then (abs(a.v - xl.v) + abs(a.v - xr.v) + abs(a.v - yl.v) + abs(a.v - yr.v) + abs(a.v - zl.v) + abs(a.v - zr.v)) / 6 else 0 end as v from e a{_SIX})
  select x, y, z, t, round(v / max(v) over (), 6) + 0.0 as v from g""")  # fmt: skip
_W8 = "8 / pow(2, dx * dx + dy * dy + dz * dz)"
add("subsamp2", "3", lambda lat: lat.subsamp2(), _NB.format(*CUBE, " and a.x % 2 = 1 and a.y % 2 = 0 and a.z % 2 = 0") + f" select (x - 1) // 2 as x, y // 2 as y, z // 2 as z, t, round(sum(v * {_W8}) / sum({_W8}), 6) + 0.0 as v{_GROUP}")
add("subsamp2offc", "3", lambda lat: lat.subsamp2offc(), " select x // 2 as x, y // 2 as y, z // 2 as z, 0 as t, round(avg(v), 6) + 0.0 as v from e group by 1, 2, 3")
add("dehaze", "3", lambda lat: lat.dehaze(3))


# lines
def _gauss_sql(sigma: float, cut: int, source: str, name: str) -> str:
    """A chain of three line smoothings."""
    out, at = "", source
    for c in "xyz":
        rest = " and ".join(f"a.{k} = b.{k}" for k in "xyzt" if k != c)
        w = f"exp(-pow(b.{c} - a.{c}, 2) / {2 * sigma * sigma!r})"
        out += f", {name}{c} as (select a.x, a.y, a.z, a.t, sum(b.v * {w}) / sum({w}) as v from {at} a join {at} b on {rest} and b.{c} between a.{c} - {cut} and a.{c} + {cut} group by a.x, a.y, a.z, a.t)"
        at = name + c
    return out


add("smooth", "3", lambda lat: lat.s(0.8), _gauss_sql(0.8, 5, "e", "g") + each("v", "gz"))
_DOG = _gauss_sql(0.8, 2, "e", "n") + _gauss_sql((1.2**2 - 0.8**2) ** 0.5, 3, "nz", "w") + ", d as (select x, y, z, t, nz.v - wz.v as v from nz join wz using (x, y, z, t))"
add("dogr", "3", lambda lat: lat.dogr(0.8, 1.2), _DOG + each("v", "d"))


def _cross(axes: str) -> str:
    cond = "".join(f" or (abs(b.{c} - a.{c}) = 1 and " + " and ".join(f"a.{k} = b.{k}" for k in "xyz" if k != c) + ")" for c in axes)[4:]
    return _DOG + f""", k as (select a.x, a.y, a.z, max(case when (a.v > 0 and b.v <= -a.v) or (a.v < 0 and b.v > -a.v) then 1.0 else 0.0 end) as v
      from d a join d b on b.z between a.z - 1 and a.z + 1 and b.x between a.x - 1 and a.x + 1 and b.y between a.y - 1 and a.y + 1 and ({cond}) group by a.x, a.y, a.z) select x, y, z, 0 as t, v + 0.0 as v from k"""  # fmt: skip


for _name, _axes in (("dog", "xyz"), ("dogx", "yz"), ("dogy", "xz"), ("dogz", "xy")):
    add(_name, "3", (lambda n: lambda lat: lat.apply(n, 0.8, 1.2))(_name), _cross(_axes))
add("unsharp", "3", lambda lat: lat.unsharp(0.8, 0.5), _gauss_sql(0.8, 2, "e", "g") + ", r as (select min(v) as mn, max(v) as mx from e) select x, y, z, t, round(least(greatest(e.v + (e.v - gz.v) * 0.5, mn), mx), 6) + 0.0 as v from e join gz using (x, y, z, t), r")


def _resize_sql(method: int) -> str:
    """Twice as many sites along x by the filter's formula; shrinking is checked in the tests."""
    t = "abs(c - j)"
    f = {
        0: "case when c - j > -0.5 and c - j <= 0.5 then 1.0 else 0.0 end",
        1: f"greatest(0.0, 1 - {t})",
        2: f"case when {t} < 1 then 0.5 * pow({t}, 3) - pow({t}, 2) + 2.0 / 3 when {t} < 2 then pow(2 - {t}, 3) / 6 else 0 end",
        3: f"case when {t} = 0 then 1.0 when {t} < 3 then sin(pi() * {t}) / (pi() * {t}) * sin(pi() * {t} / 3) / (pi() * {t} / 3) else 0 end",
        4: f"case when {t} < 1 then (7 * pow({t}, 3) - 12 * pow({t}, 2) + 16.0 / 3) / 6 when {t} < 2 then (-7.0 / 3 * pow({t}, 3) + 12 * pow({t}, 2) - 20 * {t} + 32.0 / 3) / 6 else 0 end",
    }[method]
    return f""", o as (select cast(i as int) as i, i / 2.0 as c from range(0, 16) r(i)), q as (select i, c, j from o, (select unnest(range(-3, 12)) as j) where abs(c - j) <= 3),
      w as (select i, case when j < 0 then -j when j >= 8 then 16 - j - 1 else j end as s, {f} as w from q)
      select i as x, y, z, t, round(sum(v * w), 6) + 0.0 as v from e join w on w.s = e.x group by i, y, z, t"""  # fmt: skip


for _m, _name in enumerate(("box", "linear", "spline", "lanczos", "mitchell")):
    add(f"resize_{_name}", "3", (lambda m: lambda lat: lat.resize(2, 1, 1, m))(_m), _resize_sql(_m))

# distances: only near planes can hold the nearest site at these thresholds
_D = "select a.x, a.y, a.z, min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))) as d from e a join e b on b.z between a.z - 8 and a.z + 8 where {0} group by a.x, a.y, a.z"
add("edt", "3", lambda lat: lat.edt(), f", n as ({_D.format('not b.v > 0')}) select e.x, e.y, e.z, e.t, round(case when e.v > 0 then d else 0 end, 6) + 0.0 as v from e join n using (x, y, z)")
add("sedt", "3", lambda lat: lat.sedt(), f", n as ({_D.format('not b.v > 0')}), p as ({_D.format('b.v > 0')}) select e.x, e.y, e.z, e.t, round(case when e.v > 0 then n.d else -p.d end, 6) + 0.0 as v from e join n using (x, y, z) join p using (x, y, z)")
add("dilate", "3", lambda lat: lat.dilate(0.15, 1.5), f", n as ({_D.format('b.v >= 0.15')})" + " select e.x, e.y, e.z, e.t, round(case when d <= 1.5 then v else 0 end, 6) + 0.0 as v from e join n using (x, y, z)")
add("erode", "3", lambda lat: lat.erode(-0.05, 1.5), f", n as ({_D.format('b.v < -0.05')})" + " select e.x, e.y, e.z, e.t, round(case when d >= 1.5 then v else 0 end, 6) + 0.0 as v from e join n using (x, y, z)")
add("close", "3", lambda lat: lat.close(0.15, 1.5, 0), f", n as ({_D.format('b.v >= 0.15')})" + " select e.x, e.y, e.z, e.t, round(case when d < 1.5 then greatest(v, 0.15) else v end, 6) + 0.0 as v from e join n using (x, y, z)")


# connectivity
def _label_sql(conn: int) -> str:
    reach = {6: 1, 18: 2, 26: 3}[conn]
    return f"""with recursive {E3.replace("e as (", "e0 as (", 1)}, e as (select *, x + 8 * (y + 8 * z) as i, v > 0.2 as m from e0),
      b as (select a.i, b.i as j from e a join e b on a.m and b.m and a.i <> b.i and b.z between a.z - 1 and a.z + 1 and b.x between a.x - 1 and a.x + 1 and b.y between a.y - 1 and a.y + 1 and abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) <= {reach}),
      r as (select i, i as root from e where m union select b.j, r.root from r join b on b.i = r.i and r.root < b.j),
      g as (select i, min(root) as root from r group by i), k as (select i, dense_rank() over (order by root) as n from g)
      select x, y, z, t, coalesce(n, 0) + 0.0 as v from e left join k using (i)"""  # fmt: skip


def _sparse(lat: Lattice) -> Lattice:
    """A sparse mask, without closed bubbles."""
    return lat.with_df(lat.df.withColumn("v", F.when(F.col("v") > 0.2, 1.0).otherwise(0.0)))


for _c in (6, 18, 26):
    add(f"bwlabel{_c}", "3", (lambda c: lambda lat: _sparse(lat).bwlabel(c))(_c))
    ORACLES[f"bwlabel{_c}"] = _label_sql(_c)
add("fillh", "3", lambda lat: lat.fillh())
add("fillh26", "3", lambda lat: lat.fillh26())
add("tfce", "3", lambda lat: lat.tfce(2, 0.5, 6))
add("tfceS", "3", lambda lat: lat.tfceS(2, 0.5, 6, 3, 3, 3, 0.0001))
add("hollow", "3", lambda lat: lat.hollow(-0.2, 1))

# geometry
_FLIP = ((-1.0, 0, 0, 7), (0, 0, 1.0, 0), (0, 1.0, 0, 0))
add("ras", "3", lambda lat: lat.with_df(lat.df, affine=_FLIP).ras(), " select 7 - x as x, z as y, y as z, t, round(v, 6) + 0.0 as v from e")
_HALF = ((1.0, 0, 0, 0.5), (0, 1.0, 0, 0.0), (0, 0, 1.0, 0.25))


def _target(lat: Lattice) -> Lattice:
    return lat.with_df(lat.df, affine=_HALF)


add("reslice_linear", "3", lambda lat: lat.reslice(_target(lat)), """, m as (select min(v) as low from e), g as (select a.x, a.y, a.z, sum(b.v * 0.5 * (case when b.z = a.z then 0.75 else 0.25 end)) as v, count(*) as n
  from e a join e b on b.x between a.x and a.x + 1 and b.y = a.y and b.z between a.z and a.z + 1 group by a.x, a.y, a.z)
  select x, y, z, 0 as t, round(case when n = 4 then v else low end, 6) + 0.0 as v from g, m""")  # fmt: skip
add("reslice_nn", "3", lambda lat: lat.reslice_nn(_target(lat)), ", m as (select min(v) as low from e) select a.x, a.y, a.z, a.t, round(coalesce(b.v, low), 6) + 0.0 as v from e a left join e b on b.x = a.x + 1 and b.y = a.y and b.z = a.z, m")
add("reslice_mask", "3", lambda lat: lat.reslice_mask(lat), ", m as (select min(v) as low from e)" + each("case when v > 0 then v else low end", "e, m"))
add("conform", "3", lambda lat: lat.conform(), out=lambda lat: lat.df.groupBy("z").agg(F.count("*").alias("voxels"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.max("v"), 6).alias("top")))  # by slice: 256 rows for 256 ** 3 voxels
add("comply", "3", lambda lat: lat.comply(16, 16, 16, 0.5, 0.5, 1, 0.98, 1))
add("robustfov", "3", lambda lat: lat.robustfov(60), " select x, y, cast(z - (mz - 59) as int) as z, t, round(v, 6) + 0.0 as v from e, (select max(z) as mz from e) where z >= mz - 59")


def _moved(lat: Lattice) -> Lattice:
    """The image a third of a voxel aside, by its header."""
    return lat.with_df(lat.df, affine=((1.0, 0, 0, 0.3), (0, 1.0, 0, 0.0), (0, 0, 1.0, 0.3)))


add("allineate", "3", lambda lat: _moved(lat).allineate(lat, "ls", "sho"))
add("deface", "3", lambda lat: _moved(lat).deface(lat, lat.bin(), "ls"))

# tensors
_SIX4 = lambda lat: lat.crop(0, 6).add(1)
_SWAPPED = " select x, y, z, case when t = 2 then 3 when t = 3 then 2 else t end as t, round(v + 1, 6) + 0.0 as v from e where t < 6"
add("tensor_2lower", "4", lambda lat: _SIX4(lat).tensor_2lower(), _SWAPPED)
add("tensor_2upper", "4", lambda lat: _SIX4(lat).tensor_2upper(), _SWAPPED)
add("tensor_decomp", "4", lambda lat: _SIX4(lat).tensor_decomp())
add("tensor_decomp_lower", "4", lambda lat: _SIX4(lat).tensor_decomp_lower())
_GRAD = np.random.default_rng(3).normal(size=(3, 20))
add("dtifit", "4", lambda lat: tensor.dtifit(lat.crop(0, 20).abs().add(2).mul(500), [0, 0] + [1000] * 18, _GRAD / np.linalg.norm(_GRAD, axis=0))[0])
add("unifize", "3", lambda lat: lat.abs().unifize())


def _surface(lat: Lattice) -> DataFrame:
    vertices, _ = mesh.isosurface(lat, 0.1)
    return vertices.select("vid", *(F.round(c, 6).alias(c) for c in "xyz"))


add("mesh", "3", lambda lat: lat, out=_surface)
add("mesh_triangles", "3", lambda lat: lat, out=lambda lat: mesh.isosurface(lat, 0.1)[1])
add("bitmap", "3", lambda lat: lat, out=lambda lat: lat.df.sparkSession.createDataFrame([(len(bitmap.bitmap(lat)),)], "png_bytes long"))


def _through_bytes(lat: Lattice) -> Lattice:
    """Encoded as an image file and decoded again, run by run on the executors."""
    head = nifti.parse_header(nifti.header_bytes(lat, "double", nifti.least_version(lat)))
    return lat.with_df(nifti.decoded(nifti.encoded(lat, "double"), head))


add("nifti_roundtrip", "4", lambda lat: _through_bytes(lat), " select x, y, z, t, round(v, 6) + 0.0 as v from e")
for _name in ("MD", "MO", "L1", "L3"):
    add(f"tensor_{_name}", "4", (lambda n: lambda lat: tensor.part(tensor.parts(_SIX4(lat)), n))(_name))

# the trace over three, 0 where a principal minor is negative, which is where an eigenvalue is
ORACLES["tensor_MD"] = f"""with {E4}, m as (select x, y, z, {", ".join(f"max(case when t = {k} then v + 1 end) as {c}" for k, c in enumerate(("xx", "xy", "xz", "yy", "yz", "zz")))} from e where t < 6 group by x, y, z)
  select x, y, z, 0 as t, round(case when least(xx, yy, zz, xx * yy - xy * xy, xx * zz - xz * xz, yy * zz - yz * yz,
  xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz)) < 0 then 0 else (xx + yy + zz) / 3 end, 6) + 0.0 as v from m"""


def demean_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``-Tmean -mul -1 -add image``: a reduction, a scalar, and a join of a volume with a series."""
    image = views.emb4d(spark, sf_dir)
    return rows(image.Tmean().mul(-1).add(image))


QUERIES["demean_chain"] = demean_chain
ORACLES["demean_chain"] = f"with {E4}" + each(f"v - avg(v) over ({_S})")
