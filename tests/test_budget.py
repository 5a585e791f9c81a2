"""Budgeted allocation: golden cases, greedy equivalence, accounting."""

import random

import pytest
from pyspark.sql import functions as F

from corpusflow.operators import budget as B

# golden input: six groups, scores 0.001 * (i + 1)
SCORES = [(i, f"layer_{i}_q_lin", 0.001 * (i + 1)) for i in range(6)]
U = B.unit_cost(2, 768)


def _alloc(spark, scores, base, budget, lo=2, hi=62, u=U):
    g = spark.createDataFrame(scores, "pos int, name string, score double")
    a = B.allocate(g, score="score", pos="pos", base=base, min_units=lo, max_units=hi, unit_cost=u, budget=budget)
    return a.orderBy("pos").select("norm", "units_initial", "units").collect()


def test_normalised_and_initial(spark):
    rows = _alloc(spark, SCORES, 8, 75000)
    assert [round(r.norm, 4) for r in rows] == [0.25, 1.9681, 2.767, 3.2932, 3.6862, 4.0]
    assert [r.units_initial for r in rows] == [2, 15, 22, 26, 29, 32]


@pytest.mark.parametrize("base,budget,expected,total", [
    (8, 75000, [3, 4, 4, 4, 5, 5], 76800),
    (8, 145000, [3, 9, 9, 9, 9, 9], 147456),
    (8, 150000, [4, 9, 9, 9, 9, 10], 153600),
    (4, 37500, [2, 2, 2, 2, 2, 2], 36864),
])
def test_golden_allocations(spark, base, budget, expected, total):
    rows = _alloc(spark, SCORES, base, budget)
    assert [r.units for r in rows] == expected
    assert sum(expected) * U == total


def greedy(scores, base, budget, lo, hi, u):
    """Independent greedy loop written from the documented rules (test oracle)."""
    import math
    vals = [s for _, _, s in scores]
    mn, mx = min(vals), max(vals)
    ranks = []
    for s in vals:
        if mx == mn:
            n = 1.0
        else:
            x = (s - mn) / (mx - mn)
            n = 0.25 + 3.75 * (math.log1p(x * 10) / math.log1p(10))
        ranks.append(max(lo, min(hi, int(base * n))))
    for _ in range(1000):
        t = sum(ranks) * u
        if t <= budget:
            break
        order = sorted(range(len(ranks)), key=lambda i: -ranks[i])
        done = False
        for i in order:
            if ranks[i] > lo and t - u >= budget * 0.97:
                ranks[i] -= 1
                done = True
                break
        if not done:
            break
    for _ in range(1000):
        t = sum(ranks) * u
        if t + u > budget * 1.03:
            break
        order = sorted(range(len(ranks)), key=lambda i: ranks[i])
        done = False
        for i in order:
            if ranks[i] < hi:
                ranks[i] += 1
                done = True
                break
        if not done:
            break
    return ranks


def test_closed_form_equals_greedy(spark):
    rnd = random.Random(7)
    cases = []
    for c in range(40):
        n = rnd.randint(1, 12)
        scores = [(i, f"g{i}", rnd.choice([0.5, rnd.random()])) for i in range(n)]
        base, budget = rnd.randint(1, 16), rnd.randint(1000, 400000)
        lo, hi = rnd.randint(1, 3), rnd.randint(4, 40)
        cases.append((c, scores, base, budget, lo, hi))
    rows = []
    for c, scores, base, budget, lo, hi in cases:
        rows += [(c, p, s, base, budget, lo, hi) for p, _, s in scores]
    df = spark.createDataFrame(rows, "case int, pos int, score double, base int, budget int, lo int, hi int")
    got = {}
    for c, scores, base, budget, lo, hi in cases[:15]:
        sub = df.where(F.col("case") == c)
        a = B.allocate(sub, score="score", pos="pos", base=base, min_units=lo, max_units=hi,
                       unit_cost=U, budget=budget).orderBy("pos").select("units").collect()
        got[c] = [r.units for r in a]
        assert got[c] == greedy(scores, base, budget, lo, hi, U), (c, scores, base, budget, lo, hi)


def test_sweep_scenarios(spark):
    g = spark.createDataFrame(SCORES, "pos int, name string, score double")
    budgets = spark.createDataFrame([(75000,), (145000,), (150000,)], "budget int")
    x = g.crossJoin(budgets)
    a = B.allocate(x, score="score", pos="pos", base=8, min_units=2, max_units=62, unit_cost=U,
                   budget="budget", scenario=["budget"])
    res = {}
    for r in a.orderBy("budget", "pos").collect():
        res.setdefault(r.budget, []).append(r.units)
    assert res[75000] == [3, 4, 4, 4, 5, 5]
    assert res[145000] == [3, 9, 9, 9, 9, 9]
    assert res[150000] == [4, 9, 9, 9, 9, 10]


def test_equal_scores_and_budget_below_minimum(spark):
    eq = [(i, f"g{i}", 0.3) for i in range(4)]
    rows = _alloc(spark, eq, 8, 10)  # budget far below min * groups
    assert all(r.norm == 1.0 for r in rows)
    assert [r.units for r in rows] == [2, 2, 2, 2]


def test_verify_flags(spark):
    g = spark.createDataFrame(SCORES, "pos int, name string, score double")
    a = B.allocate(g, score="score", pos="pos", base=8, min_units=2, max_units=62, unit_cost=U, budget=75000)
    st = B.verify_allocation(B.allocation_stats(a, 75000, U)).collect()[0]
    assert st.total_cost == 76800 and not st.error_over and not st.warn_under
    B.raise_if_invalid(B.verify_allocation(B.allocation_stats(a, 75000, U)))
    with pytest.raises(ValueError):
        B.raise_if_invalid(B.verify_allocation(B.allocation_stats(a, 50000, U)))


def test_one_group_gets_what_fits(spark):
    rows = _alloc(spark, [(0, "only", 0.5)], 8, 30000)
    assert rows[0].norm == 1.0 and rows[0].units_initial == 8
    # 8 units cost 24576 <= 30000; raising while <= 1.03 * 30000 reaches 10 units
    assert rows[0].units == 10


def test_tied_scores_keep_position_order(spark):
    tied = [(0, "a", 0.1), (1, "b", 0.9), (2, "c", 0.9), (3, "d", 0.1)]
    rows = _alloc(spark, tied, 8, 60000)
    assert [r.units for r in rows] == greedy(tied, 8, 60000, 2, 62, U)


def test_model_info_reproduces_stored_budgeted_run(spark):
    """Accounting over a parameter inventory built from the model structure
    reproduces the stored run's model_info: a frozen base, rank-2 low-rank
    factors on q/v of six layers (width 768), and the classification head."""
    rows = [("distilbert.base.frozen", 66955010, False)]
    for layer in range(6):
        for mod in ("q_lin", "v_lin"):
            for part in ("lora_A", "lora_B"):
                rows.append((f"base_model.model.distilbert.transformer.layer.{layer}.attention.{mod}.{part}.default.weight",
                             2 * 768, True))
    rows += [("pre_classifier.weight", 768 * 768, True), ("pre_classifier.bias", 768, True),
             ("classifier.weight", 768 * 2, True), ("classifier.bias", 2, True)]
    inv = spark.createDataFrame(rows, "name string, numel bigint, trainable boolean")
    m = B.model_info(inv, budget=37500).collect()[0]
    assert (m.total_parameters, m.trainable_parameters, m.frozen_parameters) == (67584004, 628994, 66955010)
    assert (m.peft_parameters, m.added_parameters, m.task_head_parameters) == (36864, 36864, 592130)
    assert abs(m.trainable_percentage - 0.9306847223789818) < 1e-12
    assert abs(m.parameter_efficiency - 99.06931527762102) < 1e-10
    assert abs(m.budget_usage_percentage - 98.304) < 1e-9 and m.budget_remaining == 636 and m.within_budget
    # the same 36,864 is the allocation cost of the golden case "base 4, budget 37,500 -> all 2"
    assert sum(r.units for r in _alloc(spark, SCORES, 4, 37500)) * U == 36864


def _inventory(spark, rank):
    rows = [("distilbert.base.frozen", 66955010, False)]
    for layer in range(6):
        for mod in ("q_lin", "v_lin"):
            for part in ("lora_A", "lora_B"):
                rows.append((f"base_model.model.distilbert.transformer.layer.{layer}.attention.{mod}.{part}.default.weight",
                             rank * 768, True))
    rows += [("pre_classifier.weight", 768 * 768, True), ("pre_classifier.bias", 768, True),
             ("classifier.weight", 768 * 2, True), ("classifier.bias", 2, True)]
    return spark.createDataFrame(rows, "name string, numel bigint, trainable boolean")


@pytest.mark.parametrize("rank,trainable", [(4, 665858), (8, 739586), (12, 813314)])
def test_model_info_fixed_ranks_match_stored_summary(spark, rank, trainable):
    m = B.model_info(_inventory(spark, rank)).collect()[0]
    assert m.trainable_parameters == trainable and m.task_head_parameters == 592130
    if rank == 4:  # the stored fixed-rank-4 result
        assert m.total_parameters == 67620868 and m.peft_parameters == 73728
        assert abs(m.trainable_percentage - 0.9846930684178736) < 1e-12
        assert abs(m.parameter_efficiency - 99.01530693158213) < 1e-10
