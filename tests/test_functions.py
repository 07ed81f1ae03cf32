import itertools
import math

import numpy as np
import pandas as pd
import pytest

from assaylens.functions import ordered, tails
from assaylens.session import materialise


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(3)
    rows = pd.DataFrame({"k": rng.choice(["a", "b"], 60, p=[0.8, 0.2]), "v": rng.integers(0, 25, 60) / 4.0})
    return rows, materialise(spark.createDataFrame(rows), "values")


def counted(df):
    return materialise(df.groupBy("k", "v").count().withColumnRenamed("count", "n"), "counts")


def check_running(rows, df):
    counts = counted(df)
    up = ordered.running(counts, ["k"], "v", {"cum": ("sum", "n"), "low": ("min", "n")}).toPandas()
    down = ordered.running(counts, ["k"], "v", {"cum": ("sum", "n"), "top": ("max", "v")}, descending=True).toPandas()
    for r in up.itertuples():
        below = rows[(rows.k == r.k) & (rows.v <= r.v)]
        assert r.cum == len(below) and r.low == below.groupby("v").size().min()
    for r in down.itertuples():
        above = rows[(rows.k == r.k) & (rows.v >= r.v)]
        assert r.cum == len(above) and r.top == above.v.max()


def test_running(values):
    check_running(*values)


def test_running_with_cut_groups(values, tiny_groups):
    check_running(*values)


def check_ranks(rows, df):
    for descending in (False, True):
        expected = rows.assign(r=rows.groupby("k").v.rank(ascending=not descending)).drop_duplicates(["k", "v"])
        expected = {(r.k, r.v): r.r for r in expected.itertuples()}
        mids = ordered.mid_ranks(counted(df), ["k"], "v", "n", "r", descending).collect()
        assert {(r.k, r.v): r.r for r in mids} == expected
        rowwise = ordered.average_rank(df, ["k"], "v", "r", descending).collect()
        assert len(rowwise) == len(rows) and all(r.r == expected[(r.k, r.v)] for r in rowwise)


def test_average_tie_ranks(values):
    check_ranks(*values)


def test_average_tie_ranks_with_cut_groups(values, tiny_groups):
    check_ranks(*values)


def check_quantiles(rows, df):
    fractions = {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q90": 0.9, "q100": 1.0}
    for r in ordered.quantiles(counted(df), ["k"], "v", "n", fractions).collect():
        for name, f in fractions.items():
            assert r[name] == pytest.approx(np.quantile(rows[rows.k == r.k].v, f), abs=1e-12)


def test_quantiles(values):
    check_quantiles(*values)


def test_quantiles_with_cut_groups(values, tiny_groups):
    check_quantiles(*values)


def test_exact_rank_sum_against_all_permutations():
    for n1, n0 in ((1, 1), (2, 3), (3, 3), (4, 5), (5, 2)):
        us = [
            sum(p) - n1 * (n1 + 1) / 2 for p in itertools.combinations(range(1, n1 + n0 + 1), n1)
        ]
        for u in range(n1 * n0 + 1):
            top = max(u, n1 * n0 - u)
            p = min(1.0, 2 * sum(x >= top for x in us) / len(us))
            assert tails.rank_sum_exact(u, n1, n0) == pytest.approx(p, abs=1e-14)


def test_rank_sum_chooses_exact_only_without_ties():
    assert tails.rank_sum_p(0, 3, 3, 0) == pytest.approx(0.1)
    assert tails.rank_sum_p(0, 3, 3, 6) != pytest.approx(0.1)
    # tied sample compared with a permutation estimate of 0.029 in 100,000 draws
    assert 0 < tails.rank_sum_p(30, 20, 6, 60) < 1


# fixed values: correlation, pairs and p of published panel-score results
PUBLISHED = [
    (0.07303902355747402, 847, 0.03355541123162104),
    (0.057648542947959416, 918, 0.08085660161066476),
    (0.04859472846839054, 912, 0.14254416420615093),
    (0.03276074076709854, 845, 0.34152124831300035),
    (0.03800157468534258, 846, 0.26955784625571483),
    (0.06793230580545616, 847, 0.048107721598804776),
    (0.08298985137710851, 918, 0.011890298713867669),
    (0.12055542749925331, 912, 0.00026324553441142847),
    (0.0020350212874514907, 845, 0.9528977153497501),
    (0.09109505481844393, 846, 0.008020765083980511),
]


@pytest.mark.parametrize("rho,n,p", PUBLISHED)
def test_correlation_p_values(rho, n, p):
    t = rho * math.sqrt((n - 2) / (1 - rho * rho))
    assert tails.student_two_sided(t, n - 2) == pytest.approx(p, rel=1e-9)


def test_student_tail_is_continuous_where_the_method_changes():
    for t in (0.1, 1.0, 2.5, 4.0):
        finite, series = tails.student_two_sided(t, 1000), tails.student_two_sided(t, 1001)
        assert series < finite
        assert series == pytest.approx(finite, rel=5e-2 * t**4 / 1000 + 1e-5)
    # t with few degrees has closed forms
    assert tails.student_two_sided(1.0, 1) == pytest.approx(0.5)
    assert tails.student_two_sided(2.0, 2) == pytest.approx(1 - 2 / math.sqrt(6))
    assert tails.student_two_sided(1.5, 3) == pytest.approx(1 - 2 / math.pi * (math.atan(1.5 / math.sqrt(3)) + 1.5 / math.sqrt(3) / (1 + 0.75)))


def test_missing_keys_and_values_survive_the_cut(spark, tiny_groups):
    rows = [("a", float(i % 30)) for i in range(90)] + [("a", None)] * 3 + [(None, 1.0), (None, 2.0), (None, None)]
    df = materialise(spark.createDataFrame(rows, "k string, v double"), "rows")

    def ranks():
        return sorted(((r.k, r.v, r.rank) for r in ordered.average_rank(df, ["k"], "v", "rank").collect()), key=str)

    cut = ranks()
    spark.conf.set("assaylens.groupRows", "1000")
    assert len(cut) == len(rows) and cut == ranks()


def test_exact_law_of_large_classes():
    # without ties and with one in the smaller class every place is equally likely
    assert tails.rank_sum_exact(0, 1, 8_000_000) == pytest.approx(2 / 8_000_001, rel=1e-12)
    # U at most 1 of two among m: the least sums 0 and 1
    assert tails.rank_sum_exact(1, 2, 4_000_000) == pytest.approx(2 * 2 / math.comb(4_000_002, 2), rel=1e-12)


@pytest.mark.parametrize("df", [999, 1000, 1001])
def test_student_tail_is_relative(df):
    # by the density, integrated far out
    steps = np.linspace(12, 60, 2_000_001)
    log_c = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi)
    dense = np.exp(log_c - (df + 1) / 2 * np.log1p(steps**2 / df))
    h = steps[1] - steps[0]
    simpson = h / 3 * (dense[0] + dense[-1] + 4 * dense[1:-1:2].sum() + 2 * dense[2:-1:2].sum())
    assert tails.student_two_sided(12, df) == pytest.approx(2 * simpson, rel=1e-9)
