"""Reductions of one axis, global statistics with their pointwise use, and comparison."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from gridloom.functions import numeric as N
from gridloom.lattice import K, Lattice
from gridloom.operators import REGISTRY, operator

AXES = {"X": "x", "Y": "y", "Z": "z", "T": "t"}


def reduced(lat: Lattice, axis: str, what: str, percent: int | None = None) -> Lattice:
    """Collapse an axis; one that has a single index stays as it is."""
    at = {"x": 0, "y": 1, "z": 2, "t": 3}[axis]
    n = lat.shape[at]
    if n <= 1:
        return lat
    keys = [c for c in ("t", "z", "y", "x") if c != axis]
    v = F.col("v").cast("double")
    sorted_ = F.array_sort(F.collect_list(v))
    if what == "ar1":
        w = Window.partitionBy(*keys)
        d = lat.df.withColumn("d", v - F.avg(v).over(w)).withColumn("p", F.lag("d").over(w.orderBy(axis)))
        ss = F.sum(F.col("d") * F.col("d"))
        out = d.groupBy(*keys).agg(F.when(ss == 0, 0.0).otherwise(F.sum(F.col("d") * F.col("p")) / F.when(ss != 0, ss)).alias("v"))
    else:
        agg = {
            "mean": lambda: F.avg(v),
            "sum": lambda: F.sum(v),
            "max": lambda: F.max(v),
            "min": lambda: F.min(v),
            "maxn": lambda: F.min_by(F.col(axis), F.struct(-v, F.col(axis))).cast("double"),
            "std": lambda: F.coalesce(F.stddev_samp(v), F.lit(N.NAN)),
            "median": lambda: F.element_at(sorted_, int(n * 0.5) + 1),
            "perc": lambda: F.element_at(sorted_, min(max(int(n * int(percent or 0) / 100), 0), n - 1) + 1),
        }[what]()
        out = lat.df.groupBy(*keys).agg(agg.alias("v"))
    shape, pix = list(lat.shape), lat.pix
    shape[at] = 1
    return lat.with_df(out.withColumn(axis, F.lit(0)), shape=tuple(shape), pix=pix)


for _flag, _axis in AXES.items():
    for _what in ("mean", "std", "max", "maxn", "min", "median", "sum", "ar1"):
        REGISTRY[_flag + _what] = (lambda a, w: lambda lat: reduced(lat, a, w))(_axis, _what)
    REGISTRY[_flag + "perc"] = (lambda a: lambda lat, p: reduced(lat, a, "perc", int(float(p))))(_axis)

BINS = 1001


def robust_range(lat: Lattice, nonzero: bool = False):
    """A one-row DataFrame ``lo, hi``: the range without two percent of the values at either end.

    From a histogram of 1001 bins, which is an aggregate; the walk over the bins is a window over at most
    1001 rows. NaN is left out, and zeros are on request. Below 100 values or with constant values the full
    range is returned.
    """
    use = lat.df.where(~F.isnan("v") & (F.col("v") != 0) if nonzero else ~F.isnan("v"))
    stats = use.agg(F.min("v").alias("mn"), F.max("v").alias("mx"), F.count("*").alias("n"))
    hist = (
        use.crossJoin(F.broadcast(stats))
        .where("mx > mn")
        .withColumn("b", F.floor((F.col("v") - F.col("mn")) * (F.lit(BINS - 1.0) / F.when(F.col("mx") > F.col("mn"), F.col("mx") - F.col("mn"))) + 0.5).cast("int"))
        .groupBy("b")
        .count()
    )
    cut = F.floor(F.col("n") * 0.02 + 0.5)
    up, down = Window.orderBy("b"), Window.orderBy(F.desc("b"))
    walked = hist.withColumns({"c": F.sum("count").over(up), "d": F.sum("count").over(down), "prev": F.lag("b").over(up), "next": F.lead("b").over(up)}).crossJoin(F.broadcast(stats))
    ends = walked.agg(
        F.min(F.when(F.col("c") >= cut, F.col("b"))).alias("lo"),
        F.max(F.when(F.col("d") >= cut, F.col("b"))).alias("hi"),
        F.min_by("prev", F.when(F.col("c") >= cut, F.col("b"))).alias("prev"),
        F.min_by("next", F.when(F.col("c") >= cut, F.col("b"))).alias("next"),
    )
    scale = F.lit(BINS - 1.0) / F.when(F.col("mx") > F.col("mn"), F.col("mx") - F.col("mn"))
    same = F.col("lo") == F.col("hi")  # then the nearest bin with values, below or above, widens the range
    lo = F.when(same & F.col("prev").isNotNull() & (F.col("next").isNull() | (F.col("lo") - F.col("prev") <= F.col("next") - F.col("lo"))), F.col("prev")).when(same, F.greatest(F.lit(0), 2 * F.col("lo") - F.coalesce("next", F.lit(BINS - 1)))).otherwise(F.col("lo"))
    hi = F.when(same & F.col("next").isNotNull() & (F.col("prev").isNull() | (F.col("next") - F.col("hi") < F.col("lo") - F.col("prev"))), F.col("next")).when(same, F.least(F.lit(BINS - 1), 2 * F.col("hi") - F.coalesce("prev", F.lit(0)) - 1)).otherwise(F.col("hi"))
    full = (cut < 1) | (F.col("n") < 100) | (F.col("mx") == F.col("mn"))
    return stats.crossJoin(F.broadcast(ends)).select(F.when(full, F.col("mn")).otherwise(lo / scale + F.col("mn")).alias("lo"), F.when(full, F.col("mx")).otherwise(hi / scale + F.col("mn")).alias("hi"))


def _threshold(name: str):
    nonzero, above, clamp = name.endswith("P"), name.startswith("u"), "clamp" in name

    def run(lat: Lattice, percent):
        row = robust_range(lat, nonzero).select((F.col("lo") + (F.col("hi") - F.col("lo")) * (float(percent) / 100)).alias("thr"))
        to = F.col("thr") if clamp else N.zero()
        return lat.with_row(row, lambda v: F.when(N.gt(v, F.col("thr")) if above else v < F.col("thr"), to).otherwise(v))

    return run


for _name in ("thrp", "thrP", "uthrp", "uthrP", "clamp", "uclamp"):
    REGISTRY[_name] = _threshold(_name)


@operator("scale01")
def scale01(lat):
    """Scale the values to 0..1; a constant image is left alone."""
    row = lat.df.agg(F.min("v").alias("mn"), F.max("v").alias("mx"))
    return lat.with_row(row, lambda v: F.when(F.col("mx") > F.col("mn"), (v - F.col("mn")) / F.when(F.col("mx") > F.col("mn"), F.col("mx") - F.col("mn"))).otherwise(v))


@operator("inm")
def inm(lat, mean):
    """Scale each volume to a mean of its positive values."""
    means = lat.df.groupBy("t").agg(F.avg(F.when(N.gt(F.col("v"), 0), F.col("v"))).alias("m"))  # a row for each volume, from partial sums
    m = F.col("m")
    return lat.with_df(lat.df.join(means, "t").withColumn("v", F.coalesce(F.col("v") * (F.lit(float(mean)) / F.when(m != 0, m)), F.col("v"))))


@operator("ing")
def ing(lat, mean):
    """Scale the whole image to a mean of its positive values."""
    row = lat.df.agg(F.avg(F.when(N.gt(F.col("v"), 0), F.col("v"))).alias("m"))
    return lat.with_row(row, lambda v: F.coalesce(v * (F.lit(float(mean)) / F.when(F.col("m") != 0, F.col("m"))), v))


@operator("fdr")
def fdr(lat, q):
    """Benjamini-Hochberg: p values above the largest that holds ``p <= q i / n`` become 1."""
    p = lat.df.where(~F.isnan("v")).groupBy("v").count()
    ranked = running_totals(p, "v", {"count": "i"})
    row = ranked.crossJoin(F.broadcast(p.agg(F.sum("count").alias("n")))).agg(F.max(F.when(F.col("v") <= F.col("i") * float(q) / F.col("n"), F.col("v"))).alias("cut"))
    return lat.with_row(row, lambda v: F.when(F.col("cut").isNotNull() & (v <= F.col("cut")), v).otherwise(1.0))


def running_totals(df, value: str, columns: dict[str, str], descending: bool = False, bins: int = 1024):
    """``df`` with running sums of ``columns`` (source to new name) in order of ``value``, without a global sort.

    Values fall into equal bins; sums of the bins before come from a window over at most ``bins`` rows, sums inside
    a bin from a window on the bin.
    """
    stats = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo"))
    at = F.coalesce(F.floor((F.col(value) - F.col("_lo")) / width * (bins - 1)), F.lit(0)).cast("int")
    order = (lambda c: F.col(c).desc()) if descending else F.col
    binned = df.crossJoin(F.broadcast(stats)).withColumn("_bin", at)
    sums = binned.groupBy("_bin").agg(*(F.sum(c).alias(f"_{n}") for c, n in columns.items()))
    over = Window.orderBy(order("_bin"))
    before = sums.select("_bin", *((F.sum(f"_{n}").over(over) - F.col(f"_{n}")).alias(f"_{n}") for n in columns.values()))
    inside = Window.partitionBy("_bin").orderBy(order(value))
    joined = binned.join(F.broadcast(before), "_bin")
    return joined.withColumns({n: F.col(f"_{n}") + F.sum(c).over(inside) for c, n in columns.items()}).drop("_bin", "_lo", "_hi", *(f"_{n}" for n in columns.values()))


def compare(a: Lattice, b: Lattice):
    """One row of agreement measures of two images of equal size; NaN equals NaN."""
    j = a.df.join(b.df.withColumnRenamed("v", "w"), ["t", *K])
    v, w = F.col("v"), F.col("w")
    d = F.when(F.isnan(v) & F.isnan(w), 0.0).otherwise(F.abs(v - w))
    tiny = 2.220446049250313e-16
    same = (F.isnan(v) & F.isnan(w)) | (v == w) | (d <= F.greatest(F.abs(v), F.abs(w)) * tiny)
    place = F.struct(d.alias("d"), (-a.linear_index()).alias("i"))
    return j.agg(
        F.count("*").alias("voxels"),
        F.sum(F.when(same, 1).otherwise(0)).alias("same"),
        F.corr(v, w).alias("r"),
        F.max(d).alias("max_diff"),
        (-F.max(place)["i"]).alias("at"),
        *(f(c).alias(f"{n}_{c2}") for c, c2 in ((v, "a"), (w, "b")) for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("sd", F.stddev_samp))),
    )
