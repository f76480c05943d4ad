"""Grid anomaly detection on 2-D points.

Points are ``(src, row_id, x, y)``. The edges are one small row computed by a
single aggregate and broadcast; every point gets its cell by arithmetic
(O(N + cells) instead of scanning all points per cell), with a one-step
correction against the stored edge values so that points exactly on an edge
land where NumPy's half-open bins put them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import binom_greater, binom_less
from .fdr import bh_adjust
from .reshape import is_real, is_synth

REAL_OVER, SYNTH_OVER = "real_overpopulation", "synthetic_overpopulation"
# Cell colours of the reference report.
REAL_COLOR, SYNTH_COLOR, DEFAULT_COLOR = "#FF0000", "#0000FF", "#CCCCCC"


def grid_bounds(points: DataFrame, x_bins: int = 20, y_bins: int = 20, pad: float = 0.01) -> DataFrame:
    """One row with min/max/step per axis and the padded outer edges.

    Equal-width edges over both sides: e_i = min + i * (max - min) / bins;
    the outer edges move out by ``pad`` of the range; a constant axis
    spans [v - 0.5, v + 0.5] (NumPy's rule).
    """
    a = points.agg(F.min("x").alias("x_min"), F.max("x").alias("x_max"),
                   F.min("y").alias("y_min"), F.max("y").alias("y_max"),
                   F.count("*").alias("n_points"))
    cols = []
    for ax, b in (("x", x_bins), ("y", y_bins)):
        lo, hi = F.col(f"{ax}_min"), F.col(f"{ax}_max")
        const = hi == lo
        start = F.when(const, lo - 0.5).otherwise(lo)
        stop = F.when(const, lo + 0.5).otherwise(hi)
        cols += [start.alias(f"{ax}_start"), stop.alias(f"{ax}_stop"),
                 ((stop - start) / b).alias(f"{ax}_step"), F.lit(b).alias(f"{ax}_bins"),
                 F.least(start, lo - (hi - lo) * pad).alias(f"{ax}_lo_edge"),
                 F.greatest(stop, hi + (hi - lo) * pad).alias(f"{ax}_hi_edge")]
    return a.select("n_points", *cols)


def grid_edges(bounds: DataFrame) -> DataFrame:
    """A13 as rows: (axis, idx, edge) with the padded outer edges."""
    out = []
    for ax in ("x", "y"):
        b = F.col(f"{ax}_bins")
        idx = F.explode(F.sequence(F.lit(0), b)).alias("idx")
        e = bounds.select(F.lit(ax).alias("axis"), idx, "*")
        edge = (F.when(F.col("idx") == 0, F.col(f"{ax}_lo_edge"))
                 .when(F.col("idx") == b, F.col(f"{ax}_hi_edge"))
                 .otherwise(F.col("idx") * F.col(f"{ax}_step") + F.col(f"{ax}_start")))
        out.append(e.select("axis", "idx", edge.alias("edge")))
    return out[0].unionByName(out[1])


def _cell(ax: str) -> Column:
    v, s0, st, b = F.col(ax), F.col(f"{ax}_start"), F.col(f"{ax}_step"), F.col(f"{ax}_bins")
    i0 = F.least(F.greatest(F.floor((v - s0) / st), F.lit(0)), b - 1)
    e_lo = i0 * st + s0
    e_hi = (i0 + 1) * st + s0
    return (F.when((i0 > 0) & (v < e_lo), i0 - 1)
             .when((i0 < b - 1) & (v >= e_hi), i0 + 1)
             .otherwise(i0)).cast("int")


def assign_cells(points: DataFrame, bounds: DataFrame) -> DataFrame:
    """D3: (src, row_id, x, y, cell_x, cell_y); bounds is one broadcast row."""
    j = points.crossJoin(F.broadcast(bounds))
    return j.select("src", "row_id", "x", "y", _cell("x").alias("cell_x"), _cell("y").alias("cell_y"))


def cell_counts(cells: DataFrame) -> DataFrame:
    """One groupBy over at most x_bins * y_bins groups."""
    return cells.groupBy("cell_x", "cell_y").agg(
        F.count_if(is_real()).alias("real_count"), F.count_if(is_synth()).alias("synthetic_count"))


def binomial_cells(counts: DataFrame, min_points: int = 5) -> DataFrame:
    """One-sided exact binomial test per cell against the global share.

    Cells with >= ``min_points``; 'greater' where the real share is above the
    global share, 'less' where below, no test where equal.
    """
    tr, ts = F.sum("real_count"), F.sum("synthetic_count")
    # an empty side is an error (as in the reference), raised inside the plan
    g = counts.agg(F.when((tr == 0) | (ts == 0),
                          F.raise_error(F.lit("grid anomaly detection needs real and synthetic points"))
                          .cast("double"))
                   .otherwise(tr / (tr + ts)).alias("global_proportion"))
    c = counts.crossJoin(g).select(
        "cell_x", "cell_y", F.col("real_count").cast("long").alias("real_count"),
        F.col("synthetic_count").cast("long").alias("synthetic_count"),
        (F.col("real_count") + F.col("synthetic_count")).cast("long").alias("total_count"),
        "global_proportion")
    c = c.where(F.col("total_count") >= min_points)
    c = c.select("*", (F.col("real_count") / F.col("total_count")).alias("cell_proportion"))
    c = c.select("*", (F.col("cell_proportion") - F.col("global_proportion")).alias("proportion_diff"),
                 F.when(F.col("cell_proportion") > F.col("global_proportion"), F.lit(REAL_OVER))
                  .when(F.col("cell_proportion") < F.col("global_proportion"), F.lit(SYNTH_OVER))
                  .alias("test_type"))
    c = c.where(F.col("test_type").isNotNull())
    p = F.when(F.col("test_type") == REAL_OVER,
               binom_greater("real_count", "total_count", "global_proportion")) \
         .otherwise(binom_less("real_count", "total_count", "global_proportion"))
    return c.select("cell_x", "cell_y", "real_count", "synthetic_count", "total_count",
                    "cell_proportion", "global_proportion", "proportion_diff", p.alias("p_value"),
                    "test_type")


def require_both_sides(points: DataFrame) -> None:
    """Eager check that both sides have points (one tiny job); the detection
    plan itself also raises lazily, so this is optional."""
    sides = {r["src"] for r in points.select("src").distinct().limit(2).collect()}
    missing = {"real", "synthetic"} - sides
    if missing:
        raise ValueError(f"no {' / '.join(sorted(missing))} points")


def detect_anomalies(points: DataFrame, x_bins: int = 20, y_bins: int = 20,
                     fdr_alpha: float = 0.05, min_points: int = 5, check_sides: bool = False) -> DataFrame:
    """Edges -> counts -> binomial tests -> BH per family -> colours."""
    if check_sides:
        require_both_sides(points)
    bounds = grid_bounds(points, x_bins, y_bins)
    tests = binomial_cells(cell_counts(assign_cells(points, bounds)), min_points)
    adj = bh_adjust(tests, "p_value", ["test_type"], fdr_alpha, min_tests=1,
                    tiebreak=["cell_x", "cell_y"], adjusted="p_value_adjusted", rejected="is_significant")
    color = (F.when(~F.col("is_significant"), F.lit(None).cast("string"))
              .when(F.col("test_type") == REAL_OVER, F.lit(REAL_COLOR))
              .otherwise(F.lit(SYNTH_COLOR)))
    return adj.select("*", color.alias("color"))


def point_flags(points: DataFrame, cells: DataFrame, x_bins: int = 20, y_bins: int = 20) -> DataFrame:
    """J2 + D1 statistics: per side, points in significant cells of each kind."""
    bounds = grid_bounds(points, x_bins, y_bins)
    sig = cells.where("is_significant").select("cell_x", "cell_y", "test_type")
    # significant cells are at most x_bins * y_bins rows
    j = assign_cells(points, bounds).join(F.broadcast(sig), ["cell_x", "cell_y"], "left")
    a = j.groupBy("src").agg(
        F.count("*").alias("n_points"),
        F.count_if(F.col("test_type") == REAL_OVER).alias("in_real_overpopulated"),
        F.count_if(F.col("test_type") == SYNTH_OVER).alias("in_synthetic_overpopulated"))
    return a.select("*", ((F.col("in_real_overpopulated") + F.col("in_synthetic_overpopulated"))
                          / F.col("n_points")).alias("anomaly_rate"))


def anomaly_burden(cells: DataFrame, points_total: DataFrame) -> DataFrame:
    """Sum |real - synth| over significant cells / total points (0 if none)."""
    s = cells.where("is_significant").agg(
        F.sum(F.abs(F.col("real_count") - F.col("synthetic_count"))).alias("_d"))
    return s.crossJoin(points_total).select(
        F.coalesce(F.col("_d") / F.col("n_points"), F.lit(0.0)).alias("anomaly_burden"))


def hist2d_real_edges(points: DataFrame, bins: int = 10) -> DataFrame:
    """10 x 10 shares with *real's* edges; the last bin is closed on the
    right; synthetic points outside real's range are dropped; each side is
    normalised by its in-range total."""
    r = points.where(is_real()).agg(F.min("x").alias("x_lo"), F.max("x").alias("x_hi"),
                                    F.min("y").alias("y_lo"), F.max("y").alias("y_hi"))

    def b(ax):
        lo, hi, v = F.col(f"{ax}_lo"), F.col(f"{ax}_hi"), F.col(ax)
        const = hi == lo
        start = F.when(const, lo - 0.5).otherwise(lo)
        stop = F.when(const, lo + 0.5).otherwise(hi)
        step = (stop - start) / bins
        i0 = F.least(F.greatest(F.floor((v - start) / step), F.lit(0)), F.lit(bins - 1))
        i = (F.when((i0 > 0) & (v < i0 * step + start), i0 - 1)
              .when((i0 < bins - 1) & (v >= (i0 + 1) * step + start), i0 + 1).otherwise(i0))
        inside = (v >= start) & (v <= stop)
        return F.when(inside, i).cast("int")
    j = points.crossJoin(F.broadcast(r)).select("src", b("x").alias("bin_x"), b("y").alias("bin_y"))
    j = j.where(F.col("bin_x").isNotNull() & F.col("bin_y").isNotNull())
    c = j.groupBy("bin_x", "bin_y").agg(F.count_if(is_real()).alias("_r"), F.count_if(is_synth()).alias("_s"))
    t = c.agg(F.sum("_r").alias("_tr"), F.sum("_s").alias("_ts"))
    return c.crossJoin(t).select("bin_x", "bin_y", (F.col("_r") / F.col("_tr")).alias("p_real"),
                                 (F.col("_s") / F.col("_ts")).alias("p_synthetic"))


def total_variation_2d(h: DataFrame, threshold: float = 0.1) -> DataFrame:
    """T8 on the first two numeric columns."""
    return h.agg((0.5 * F.sum(F.abs(F.col("p_real") - F.col("p_synthetic")))).alias("statistic")) \
        .select("statistic", F.when(F.col("statistic") > threshold, "REJECT").otherwise("ACCEPT").alias("result"))


def kl_divergence_2d(h: DataFrame, eps: float = 1e-10, threshold: float = 0.1) -> DataFrame:
    """KL(real || synthetic) with eps smoothing (empty real cells add 0)."""
    term = F.col("p_real") * F.log((F.col("p_real") + eps) / (F.col("p_synthetic") + eps))
    return h.agg(F.sum(term).alias("statistic")).select(
        "statistic", F.when(F.col("statistic") > threshold, "REJECT").otherwise("ACCEPT").alias("result"))
