"""Hand values and properties of the statistics (FIXTURES F2, F4, F7)."""

import math
import random

import pytest
from pyspark.sql import functions as F

from twinlens.functions import distributions as D
from twinlens.operators import assoc, dist_tests, fdr, grid
from twinlens.operators.reshape import numeric_long
from twinlens.sources.testdata import Twin


def _one(spark, text):
    return spark.sql(f"SELECT {text} AS v").collect()[0][0]


@pytest.mark.parametrize("text,expected", [
    (D.norm_sf("1.96E0"), 0.024997895148220435),
    (D.chi2_sf("1.0E1", "4"), 0.04042768199451279),
    (D.t_two_sided("2.0E0", "1.0E1"), 0.07338803477074436),
    (D.binom_sf_ge("7", "10", "5.0E-1"), 0.171875),
    (D.binom_cdf("3", "10", "5.0E-1"), 0.171875),
])
def test_tail_probabilities(spark, text, expected):
    assert _one(spark, text) == pytest.approx(expected, rel=1e-9)


def test_bh_known_pvalues(spark):
    # p = .01 .05 .1 .2 .3, alpha .05 -> only the first is rejected
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.05, 0.1, 0.2, 0.3])], "i int, p_value double")
    out = {r.i: r for r in fdr.bh_adjust(df, "p_value", None, 0.05, tiebreak=["i"]).collect()}
    assert [out[i].fdr_rejected for i in range(5)] == [True, False, False, False, False]
    assert [round(out[i].p_value_corrected, 4) for i in range(5)] == [0.05, 0.125, 0.1667, 0.25, 0.3]


def _twin(spark, real, synth):
    rows = [("real", i, float(v)) for i, v in enumerate(real)] + \
           [("synthetic", 10_000 + i, float(v)) for i, v in enumerate(synth)]
    return Twin(spark.createDataFrame(rows, "src string, row_id long, v double"), ["v"], [])


def test_ks_identical_sides_is_zero_and_symmetric(spark):
    rng = random.Random(42)
    a = [rng.gauss(0, 1) for _ in range(200)]
    b = [rng.gauss(0.5, 1) for _ in range(150)]
    same = dist_tests.ks_statistic(numeric_long(_twin(spark, a, a))).collect()[0]
    assert same.statistic == 0.0
    d1 = dist_tests.ks_statistic(numeric_long(_twin(spark, a, b))).collect()[0].statistic
    d2 = dist_tests.ks_statistic(numeric_long(_twin(spark, b, a))).collect()[0].statistic
    assert d1 == pytest.approx(d2)
    # brute force D
    grid_v = sorted(set(a + b))
    brute = max(abs(sum(x <= v for x in a) / len(a) - sum(x <= v for x in b) / len(b)) for v in grid_v)
    assert d1 == pytest.approx(brute)


def test_prefix_sums_of_any_key(spark):
    """Running totals over many ranges equal the plain ones, for numeric, string and struct keys."""
    from pyspark.sql import functions as F
    from twinlens.operators.reshape import running_totals
    rng = random.Random(7)
    rows = [(rng.choice("ab"), v, rng.randint(1, 9)) for v in rng.sample(range(10_000), 400)] + [(None, 3, 4)]
    df = spark.createDataFrame(rows, "g string, v long, n long")
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for partitions in ("8", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            for key in (F.col("v"), F.struct(F.format_string("%06d", "v"))):
                got = running_totals(df.withColumn("k", key), "g", "k", ["n"]).collect()
                for g in ("a", "b", None):
                    mine = sorted((r["v"], r["n"], r["cum_n"], r["tot_n"]) for r in got if r["g"] == g)
                    total = 0
                    for v, n, cum, tot in mine:
                        total += n
                        assert cum == total and tot == sum(m[1] for m in mine)
                assert len(got) == len(rows)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_wide_frames_keep_pairwise_correlation(spark):
    """Forty-two columns with nulls give the same pairs as ten of them."""
    from pyspark.sql import functions as F
    from twinlens.operators.correlation import pearson_pairs
    from twinlens.sources.testdata import Twin
    rng = random.Random(3)
    cols = [f"v{k}" for k in range(42)]
    rows = [("real" if i % 2 else "synthetic", i, *[None if rng.random() < 0.1 else rng.gauss(0, 1) for _ in cols])
            for i in range(60)]
    t = Twin(spark.createDataFrame(rows, "src string, row_id long, " + ", ".join(f"{c} double" for c in cols)), cols, [])
    key = lambda r: (r["col_i"], r["col_j"])
    wide = {key(r): (r["real_r"], r["synthetic_r"]) for r in pearson_pairs(t).collect()}
    assert len(wide) == 42 * 41 // 2
    for r in pearson_pairs(t, cols[:10]).collect():
        assert wide[key(r)] == pytest.approx((r["real_r"], r["synthetic_r"]))
    strict = pearson_pairs(t, cols[:10], strict=True)
    assert strict.where(F.col("real_r").isNotNull()).count() == 0


def test_one_sided_nulls_give_errors_not_crashes(spark):
    """A column lost on one side: nulls and ERROR, neither a crash nor ACCEPT."""
    from twinlens.operators import assoc, profile
    from twinlens.operators.reshape import categorical_long, numeric_long as nl
    from twinlens.sources.testdata import Twin
    rows = [("real", i, float(i % 5), "abc"[i % 3]) for i in range(40)] + [("synthetic", i, None, None) for i in range(40, 80)]
    t = Twin(spark.createDataFrame(rows, "src string, row_id long, x double, c string"), ["x"], ["c"])
    num, cat = nl(t), categorical_long(t)
    assert dist_tests.energy_distance_1d(num).first()["energy_distance"] is None
    chi = dist_tests.chi_square_test(cat).first()
    assert (chi["result"], chi["p_value"]) == ("ERROR", None)
    share = assoc.share_distances(cat).first()
    assert (share["tvd"], share["jsd"], share["wasserstein"]) == (None, None, None)
    assert all(r["synthetic_pct"] is None for r in profile.category_shares(cat).collect())
    assert all(r["synthetic_density"] is None for r in profile.histogram(num).collect())
    assert all(r["synthetic_share"] is None for r in profile.discrete_histogram(cat).collect())


def test_counts_beyond_a_long_product(spark):
    vc = spark.createDataFrame([("c", "a", 4 * 10 ** 9, 5 * 10 ** 9), ("c", "b", 6 * 10 ** 9, 5 * 10 ** 9)],
                               "column_name string, value string, n_real long, n_synth long")
    assert dist_tests.chi_square_test(None, vc=vc).first()["result"] == "REJECT"


def test_grid_separated_clouds(spark):
    # N(0,1) vs N(2,1) in 2-D, seed 42
    rng = random.Random(42)
    rows = [("real", i, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(100)] + \
           [("synthetic", 1000 + i, rng.gauss(2, 1), rng.gauss(2, 1)) for i in range(100)]
    pts = spark.createDataFrame(rows, "src string, row_id long, x double, y double")
    for bins in (5, 8, 10):
        edges = grid.grid_edges(grid.grid_bounds(pts, bins, bins)).collect()
        assert len([e for e in edges if e.axis == "x"]) == bins + 1
        cells = grid.detect_anomalies(pts, bins, bins).collect()
        assert all(c.global_proportion == pytest.approx(0.5, abs=1e-10) for c in cells)
        assert {c.test_type for c in cells} <= {grid.REAL_OVER, grid.SYNTH_OVER}
        sig = [c for c in cells if c.is_significant]
        assert sig and all(c.color in (grid.REAL_COLOR, grid.SYNTH_COLOR) for c in sig)
    counts = grid.cell_counts(grid.assign_cells(pts, grid.grid_bounds(pts, 10, 10)))
    tot = counts.agg(F.sum("real_count"), F.sum("synthetic_count")).collect()[0]
    assert tuple(tot) == (100, 100)


def test_share_distances_bounded(spark):
    rows = [("real", i, "abc"[i % 3]) for i in range(90)] + [("synthetic", 100 + i, "abcd"[i % 4]) for i in range(80)]
    t = Twin(spark.createDataFrame(rows, "src string, row_id long, c string"), [], ["c"])
    from twinlens.operators.reshape import categorical_long
    r = assoc.share_distances(categorical_long(t)).collect()[0]
    for v in (r.tvd, r.jsd, r.wasserstein):
        assert 0.0 <= v <= 1.0
    v = assoc.cramers_v_labels(categorical_long(t)).collect()[0].cramers_v
    assert 0.0 <= v <= 1.0
    assert math.isclose(r.tvd, 0.5 * (3 * abs(1 / 3 - 1 / 4) + 1 / 4))


def test_grid_empty_side_is_an_error(spark):
    pts = spark.createDataFrame([("real", i, float(i), float(i)) for i in range(20)],
                                "src string, row_id long, x double, y double")
    with pytest.raises(Exception, match="needs real and synthetic"):
        grid.detect_anomalies(pts).collect()
    with pytest.raises(ValueError):
        grid.detect_anomalies(pts, check_sides=True)


def test_two_points_succeed(spark):
    pts = spark.createDataFrame([("real", 0, 0.0, 0.0), ("synthetic", 1, 1.0, 1.0)],
                                "src string, row_id long, x double, y double")
    assert grid.detect_anomalies(pts).count() == 0  # no cell reaches 5 points


def test_knn_matches_brute_force_with_categories(spark):
    # F8-like person table: age, income numeric; education, gender categorical
    from twinlens.operators import encode, privacy
    rng = random.Random(42)
    edu = ["HS", "BSc", "MSc", "PhD"]
    rows = []
    for i in range(300):
        src = "real" if i % 2 == 0 else "synthetic"
        rows.append((src, i, rng.gauss(40, 10), rng.gauss(50000, 15000), rng.choice(edu), rng.choice("MF")))
    df = spark.createDataFrame(rows, "src string, row_id long, age double, income double, education string, gender string")
    twin = Twin(df, ["age", "income"], ["education", "gender"])
    enc, feats = encode.encode_for_distance(twin)
    got = {(r.row_id, r.rank): r.distance for r in privacy.knn(enc, feats, k=2, target_per_cell=4).collect()}
    pts = [(r.src, r.row_id, [r[f] for f in feats]) for r in enc.collect()]
    real = [p for p in pts if p[0] == "real"]
    for s_src, sid, sv in pts:
        if s_src != "synthetic":
            continue
        d = sorted(math.dist(sv, rv) for _, _, rv in real)[:2]
        assert got[(sid, 1)] == pytest.approx(d[0]) and got[(sid, 2)] == pytest.approx(d[1])


def test_knn_with_a_hot_duplicate_cluster(spark):
    # a third of all rows are one repeated point: still exact
    from twinlens.operators import privacy
    rng = random.Random(3)
    rows = []
    for i in range(240):
        src = "real" if i % 2 == 0 else "synthetic"
        if i % 3 == 0:
            rows.append((src, i, 0.5, 0.5, 0.5))
        else:
            rows.append((src, i, rng.random(), rng.random(), rng.random()))
    enc = spark.createDataFrame(rows, "src string, row_id long, a double, b double, c double")
    got = {(r.row_id, r.rank): r.distance for r in privacy.knn(enc, ["a", "b", "c"], k=2, target_per_cell=8).collect()}
    real = [(r[2], r[3], r[4]) for r in rows if r[0] == "real"]
    for r in rows:
        if r[0] != "synthetic":
            continue
        d = sorted(math.dist((r[2], r[3], r[4]), p) for p in real)[:2]
        assert got[(r[1], 1)] == pytest.approx(d[0]) and got[(r[1], 2)] == pytest.approx(d[1])


def test_wide_correlation_matches_pairwise(spark):
    from twinlens.operators import correlation
    rng = random.Random(5)
    cols = [f"c{i}" for i in range(45)]
    rows = [("real" if i % 2 else "synthetic", i, *[rng.gauss(0, 1) + (k % 3) * 0.1 * i / 100 for k in range(45)])
            for i in range(200)]
    df = spark.createDataFrame(rows, "src string, row_id long, " + ", ".join(f"{c} double" for c in cols))
    twin = Twin(df, cols, [])
    wide = {(r.col_i, r.col_j): (r.real_r, r.synthetic_r) for r in correlation.pearson_pairs(twin).collect()}
    narrow = {(r.col_i, r.col_j): (r.real_r, r.synthetic_r)
              for r in correlation.pearson_pairs(Twin(df, cols[:6], []), cols[:6]).collect()}
    for k, v in narrow.items():
        assert wide[k][0] == pytest.approx(v[0]) and wide[k][1] == pytest.approx(v[1])


def test_results_unchanged_under_repartitioning(spark):
    # SURVEY 5(c): partitioning must not change any statistic or sample
    from twinlens.operators import profile, sample
    from twinlens.sources.testdata import lineitem_twin

    from .conftest import SF_SMALL
    t = lineitem_twin(spark, SF_SMALL)

    def stats(df):
        tw = Twin(df, t.numeric, t.categorical)
        long = numeric_long(tw)
        ks = sorted((r.column_name, round(r.statistic, 12)) for r in dist_tests.ks_statistic(long).collect())
        q = sorted((r.src, r.column_name, round(r.q1, 9), round(r.q3, 9))
                   for r in profile.iqr_outliers(long).collect())
        s = sorted((r.src, str(r.row_id)) for r in sample.sample_per_side(df, 25).select("src", "row_id").collect())
        return ks, q, s
    base = stats(t.df)
    assert stats(t.df.repartition(7)) == base
    assert stats(t.df.repartition(1)) == base


def _brute_ks_sf(a, b, d):
    from itertools import combinations
    m, n = len(a), len(b)
    hits = total = 0
    for pos in combinations(range(m + n), m):
        s = set(pos)
        i = j = 0
        dmax = 0.0
        for k in range(m + n):
            if k in s:
                i += 1
            else:
                j += 1
            dmax = max(dmax, abs(i / m - j / n))
        total += 1
        hits += dmax >= d - 1e-12
    return hits / total


@pytest.mark.parametrize("m,n", [(3, 3), (5, 4), (6, 3), (7, 5)])
def test_exact_ks_matches_enumeration(m, n):
    from math import gcd

    from twinlens.functions.exact_ks import ks_exact_sf
    lcm = m * n // gcd(m, n)
    for h in range(1, lcm + 1):
        d = h / lcm
        assert ks_exact_sf(m, n, d) == pytest.approx(_brute_ks_sf([0] * m, [0] * n, d), abs=1e-12)


def test_exact_ks_known_value():
    from twinlens.functions.exact_ks import ks_exact_sf
    # samples [1,2,3] vs [4,5,6]: D = 1, two of the C(6,3) = 20 paths reach it
    assert ks_exact_sf(3, 3, 1.0) == pytest.approx(0.1)


def _f6_twin(spark):
    # four numerics; synthetic means .2 .1 0 .3 and std 1.1 1.2 1 1.1, seed 42
    rng = random.Random(42)
    shift = [(0.2, 1.1), (0.1, 1.2), (0.0, 1.0), (0.3, 1.1)]
    rows = [("real", i, *[rng.gauss(0, 1) for _ in range(4)]) for i in range(100)]
    rows += [("synthetic", 1000 + i, *[rng.gauss(m, s) for m, s in shift]) for i in range(100)]
    cols = ["var1", "var2", "var3", "var4"]
    df = spark.createDataFrame(rows, "src string, row_id long, " + ", ".join(f"{c} double" for c in cols))
    return Twin(df, cols, [])


def test_bh_properties_on_shifted_numerics(spark):
    twin = _f6_twin(spark)
    for res in (dist_tests.ks_test(numeric_long(twin)),
                fdr.bh_adjust(dist_tests.welch_t_test(numeric_long(twin)), "p_value", None, 0.05,
                              tiebreak=["column_name"])):
        rows = sorted(res.collect(), key=lambda r: r.p_value)
        assert len(rows) == 4
        adj = [r.p_value_corrected for r in rows]
        assert all(a >= r.p_value - 1e-15 for a, r in zip(adj, rows))   # adjusted >= raw
        assert adj == sorted(adj)                                        # monotone in rank
        assert all(0.0 <= a <= 1.0 for a in adj)


def test_correlated_numerics(spark):
    # x2 = x1 + noise, x3 independent, seed 42
    from twinlens.operators import correlation
    rng = random.Random(42)
    rows = []
    for i in range(200):
        x1 = rng.gauss(0, 1)
        rows.append(("real" if i % 2 == 0 else "synthetic", i, x1, x1 + rng.gauss(0, 0.3), rng.gauss(0, 1)))
    df = spark.createDataFrame(rows, "src string, row_id long, x1 double, x2 double, x3 double")
    pairs = {(r.col_i, r.col_j): r for r in correlation.pearson_pairs(Twin(df, ["x1", "x2", "x3"], [])).collect()}
    assert pairs[("x1", "x2")].real_r > 0.9 and pairs[("x1", "x2")].synthetic_r > 0.9
    assert abs(pairs[("x1", "x3")].real_r) < 0.3
    j = correlation.jennrich(correlation.pearson_pairs(Twin(df, ["x1", "x2", "x3"], []))).collect()[0]
    assert j.statistic >= 0.0 and j.result in ("ACCEPT", "REJECT")


def test_iqr_outlier_counts_match_direct_count(spark):
    from twinlens.operators import profile
    rng = random.Random(11)
    real = [rng.gauss(0, 1) for _ in range(300)] + [8.0, -9.0, 12.5]
    synth = [rng.gauss(0.2, 1.5) for _ in range(250)] + [30.0] * 4
    got = {r.src: r for r in profile.iqr_outliers(numeric_long(_twin(spark, real, synth))).collect()}

    def lin_q(xs, q):
        xs = sorted(xs)
        pos = (len(xs) - 1) * q
        lo, hi = math.floor(pos), math.ceil(pos)
        return xs[lo] + (pos - lo) * (xs[hi] - xs[lo])
    for side, xs in (("real", real), ("synthetic", synth)):
        q1, q3 = lin_q(xs, 0.25), lin_q(xs, 0.75)
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        assert got[side].q1 == pytest.approx(q1) and got[side].q3 == pytest.approx(q3)
        assert got[side].outlier_count == sum(1 for x in xs if x < lo or x > hi)


def test_two_level_path_matches_single_level_on_registered_queries(spark):
    # with >= 128 shuffle partitions prefix sums switch to the two-level form
    import __spark_entry__ as E

    from .conftest import SF_SMALL
    names = ["t1b_ks_statistic", "t11_mann_whitney", "a12_five_number", "p13_first_appearance_codes",
             "m6_fraction_subset"]

    def run():
        out = {}
        for n in names:
            rows = E.queries()[n](spark, SF_SMALL).collect()
            out[n] = sorted(tuple(str(v) for v in r) for r in rows)
        return out
    single = run()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "256")
    try:
        assert run() == single
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
