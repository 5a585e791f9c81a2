"""Budgeted allocation and its accounting.

A fixed budget is spread over groups in proportion to importance:

1. normalise scores (all equal -> 1.0, else min-max, ``ln(1+10n)/ln(11)``,
   mapped to ``0.25 + 3.75 n``);
2. initial units ``clamp(floor(base * norm), min, max)``;
3. reduce to budget: one unit at a time from the highest group (ties: first
   position), never below ``min``, stopping when the cost is within budget or
   one more step would fall below 97 % of it;
4. raise to budget: one unit at a time to the lowest group (ties: first
   position), never above ``max``, while the cost stays within 103 %.

Steps 3-4 are greedy loops in the description.  Here they are closed forms:
the number of steps ``k`` follows from the totals, and *which* units move are
the first ``k`` unit levels in the order ``(level desc, pos)`` (removal) or
``(level asc, pos)`` (addition).  A histogram of units (at most ``max + 1`` rows
a scenario, however many groups) says how many groups have each level, so a sum
over levels finds the level where the ``k`` moves end; all levels before it move
as a whole, and only the groups at that level are ranked by position
(``segmented_scan``).  ``scenario`` columns let many budgets run in one job
(B12).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.operators.ranks import segmented_scan
from corpusflow.session import checkpoint_dir


def _per_scenario(df: DataFrame, scn, *aggs: Column) -> DataFrame:
    return df.groupBy(*scn).agg(*aggs) if scn else df.agg(*aggs)


def _beside(df: DataFrame, small: DataFrame, scn) -> DataFrame:
    """``df`` with the columns of a table of one row a scenario (as many as there are budgets)."""
    return df.join(F.broadcast(small), list(scn)) if scn else df.crossJoin(F.broadcast(small))


def _lit(x) -> Column:
    return F.col(x) if isinstance(x, str) else F.lit(x)


def normalize_importance(g: DataFrame, score: str = "score", scenario=(), out: str = "norm") -> DataFrame:
    """B1: scores -> [0.25, 4.0] with log amplification; all equal -> 1.0."""
    ends = _per_scenario(g, list(scenario), F.min(score).alias("_mn"), F.max(score).alias("_mx"))
    n = F.try_divide(F.col(score) - F.col("_mn"), F.col("_mx") - F.col("_mn"))
    n = F.log1p(n * 10) / F.log1p(F.lit(10.0))
    norm = F.when(F.col("_mx") == F.col("_mn"), F.lit(1.0)).otherwise(F.lit(0.25) + 3.75 * n)
    return _beside(g, ends, scenario).withColumn(out, norm).drop("_mn", "_mx")


def initial_units(g: DataFrame, base: int, min_units: int, max_units: int,
                  norm: str = "norm", out: str = "units_initial") -> DataFrame:
    """B2: ``clamp(int(base * norm), min, max)`` (truncation)."""
    u = F.floor(F.lit(float(base)) * F.col(norm))
    return g.withColumn(out, F.greatest(F.lit(min_units), F.least(F.lit(max_units), u)).cast("int"))


def _largest_steps(start: Column, step: Column, sign: int, bound: Column) -> Column:
    """Largest ``i >= 0`` with ``start + sign*i*step`` on the right side of
    ``bound`` (``>=`` for sign -1, ``<=`` for sign +1), exact for integer
    totals below 2**53 (the float estimate is corrected by one either way)."""
    if sign < 0:
        est = F.floor((start - bound) / step)
        ok = lambda i: (start - i * step) >= bound
    else:
        est = F.floor((bound - start) / step)
        ok = lambda i: (start + i * step) <= bound
    return F.when(ok(est + 1), est + 1).when(ok(est), est).otherwise(est - 1)


def _move_units(g: DataFrame, units: str, moves: DataFrame, pos: str, scn: list[str], sign: int, end: int) -> DataFrame:
    """The first ``_moves`` unit levels move: down from the highest (``sign`` -1, ``end`` the least units) or up
    from the lowest (+1, ``end`` the most).  ``moves`` has one row a scenario."""
    level = F.explode(F.sequence(F.lit(end + 1), F.col(units)) if sign < 0 else F.sequence(F.col(units) + 1, F.lit(end)))
    some = F.col(units) > end if sign < 0 else F.col(units) < end
    by_units = g.where(some).groupBy(*scn, units).agg(F.count(F.lit(1)).alias("_n"))
    levels = by_units.select(*scn, "_n", level.alias("_lv")).groupBy(*scn, "_lv").agg(F.sum("_n").alias("_n"))
    order = Window.partitionBy(*(scn or [F.lit(0)])).orderBy(F.col("_lv").desc() if sign < 0 else F.col("_lv").asc())
    levels = levels.withColumn("_before", F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    levels = _beside(levels, moves.select(*scn, "_moves"), scn).where(F.col("_before") < F.col("_moves"))
    whole = F.col("_before") + F.col("_n") <= F.col("_moves")
    last = F.min if sign < 0 else F.max
    found = _per_scenario(levels, scn, last(F.when(whole, F.col("_lv"))).alias("_whole"), F.max(F.when(~whole, F.col("_lv"))).alias("_part"),
                          F.max(F.when(~whole, F.col("_moves") - F.col("_before"))).alias("_first"))
    # one row a scenario; scenarios without a move have none
    found = found.checkpoint(eager=True)
    g = g.join(F.broadcast(found), scn, "left") if scn else g.crossJoin(F.broadcast(found))
    moved = F.least(F.col(units), F.col("_whole") - 1) if sign < 0 else F.greatest(F.col(units), F.col("_whole"))
    g = g.withColumn("_u1", F.coalesce(moved, F.col(units)))
    if found.where(F.col("_part").isNotNull()).isEmpty():
        return g.withColumn(units, F.col("_u1").cast("int")).drop("_u1", "_whole", "_part", "_first")
    at_level = F.col(units) >= F.col("_part") if sign < 0 else F.col(units) < F.col("_part")
    ties = segmented_scan(g.where(at_level).select(*scn, pos, "_first"), scn, [pos], rank_out="_rk")
    ties = ties.where(F.col("_rk") <= F.col("_first")).select(*scn, pos, F.lit(True).alias("_hit"))
    g = g.join(ties, [*scn, pos], "left")
    to = F.col("_part") - 1 if sign < 0 else F.col("_part")
    return g.withColumn(units, F.when(F.col("_hit"), to).otherwise(F.col("_u1")).cast("int")).drop("_u1", "_whole", "_part", "_first", "_hit")


def enforce_budget(g: DataFrame, budget, unit_cost, min_units: int, max_units: int,
                   units: str = "units_initial", pos: str = "pos", scenario=(),
                   out: str = "units") -> DataFrame:
    """B3 + B4: reduce to, then raise to, the budget; exact greedy result.

    ``pos`` is unique within a scenario; ``budget`` and ``unit_cost`` are numbers or columns that are constant in one.
    """
    checkpoint_dir(g.sparkSession)
    scn = list(scenario)
    facts = [F.max(_lit(budget).cast("double")).alias("_B"), F.max(_lit(unit_cost).cast("double")).alias("_u")]
    B, u, t = F.col("_B"), F.col("_u"), F.col("_t")
    g = g.withColumn(out, F.col(units))
    facts += [F.sum(out).alias("_sum"), F.count(F.lit(1)).alias("_c")]
    down = _per_scenario(g, scn, *facts).withColumn("_t", F.col("_sum") * u)
    k1, k2 = F.ceil((t - B) / u), _largest_steps(t, u, -1, B * 0.97)
    slack = F.col("_sum") - F.col("_c") * min_units
    k = F.when(t > B, F.greatest(F.lit(0), F.least(k1, k2, slack))).otherwise(F.lit(0))
    down = down.withColumn("_moves", k.cast("bigint")).checkpoint(eager=True)
    g = _move_units(g, out, down, pos, scn, -1, min_units)
    # each move down took one unit, so the totals afterwards follow
    up = down.withColumn("_sum", F.col("_sum") - F.col("_moves")).withColumn("_t", F.col("_sum") * u)
    j = F.greatest(F.lit(0), F.least(_largest_steps(t, u, 1, B * 1.03), F.col("_c") * max_units - F.col("_sum")))
    return _move_units(g, out, up.withColumn("_moves", j.cast("bigint")), pos, scn, 1, max_units)


def allocate(groups: DataFrame, *, score: str, pos: str, base: int, min_units: int, max_units: int,
             unit_cost, budget, scenario=()) -> DataFrame:
    """``norm``, ``units_initial`` and ``units`` per group.

    The group table (one row per group and scenario, however large the data
    it was aggregated from) is read by several aggregates and joins; it is
    materialised once with a reliable ``checkpoint()`` so the upstream scan
    and aggregation run once, and the allocation steps work on the small copy.
    """
    checkpoint_dir(groups.sparkSession)
    g = normalize_importance(groups.checkpoint(eager=True), score, scenario)
    g = initial_units(g, base, min_units, max_units).checkpoint(eager=True)
    out = enforce_budget(g, budget, unit_cost, min_units, max_units, scenario=scenario, pos=pos)
    return out.checkpoint(eager=True)


# Parameter-name keywords that mark adapter (PEFT) parameters
PEFT_KEYWORDS = ["lora", "adapter", "prefix", "prompt"]


def model_info(inventory: DataFrame, budget: int | None = None, name: str = "name", numel: str = "numel",
               trainable: str = "trainable") -> DataFrame:
    """Parameter accounting over an inventory ``(name, numel, trainable)``.

    total, trainable, frozen, PEFT (trainable and a keyword in the lower-cased
    name), added (= PEFT), task head (trainable - PEFT), trainable % and
    efficiency %, and with a budget: usage %, remaining, within.  One
    aggregate row (partial sums, however many parameters are listed).
    """
    low = F.lower(F.col(name))
    is_peft = F.col(trainable) & F.exists(F.array(*[F.lit(k) for k in PEFT_KEYWORDS]), lambda k: F.instr(low, k) > 0)
    s = inventory.agg(F.sum(numel).cast("bigint").alias("total_parameters"),
                      F.sum(F.when(F.col(trainable), F.col(numel)).otherwise(0)).cast("bigint").alias("trainable_parameters"),
                      F.sum(F.when(is_peft, F.col(numel)).otherwise(0)).cast("bigint").alias("peft_parameters"))
    out = s.select(
        "total_parameters", "trainable_parameters",
        (F.col("total_parameters") - F.col("trainable_parameters")).alias("frozen_parameters"),
        "peft_parameters", F.col("peft_parameters").alias("added_parameters"),
        (F.col("trainable_parameters") - F.col("peft_parameters")).alias("task_head_parameters"),
        (F.col("trainable_parameters") / F.col("total_parameters") * 100).alias("trainable_percentage"),
        ((F.col("total_parameters") - F.col("trainable_parameters")) / F.col("total_parameters") * 100)
        .alias("parameter_efficiency"))
    if budget is not None:
        out = out.select("*", (F.col("peft_parameters") / F.lit(budget) * 100).alias("budget_usage_percentage"),
                         (F.lit(budget) - F.col("peft_parameters")).cast("bigint").alias("budget_remaining"),
                         (F.col("peft_parameters") <= F.lit(budget)).alias("within_budget"))
    return out


def cost(units: Column, unit_cost, layers: int = 1) -> Column:
    """``modules * 2 * units * width`` = ``units * unit_cost`` (x layers)."""
    return (units * _lit(unit_cost) * layers).cast("bigint")


def unit_cost(modules: int, width: int) -> int:
    """Cost of one unit: ``modules * 2 * width``."""
    return modules * 2 * width


def allocation_stats(alloc: DataFrame, budget, unit_cost_, units: str = "units", scenario=()) -> DataFrame:
    """Groups, total cost, budget, usage, min/max/mean/population std."""
    scn = list(scenario)
    agg = [F.count(F.lit(1)).alias("n_groups"), F.sum(cost(F.col(units), unit_cost_)).alias("total_cost"),
           F.min(units).alias("min_units"), F.max(units).alias("max_units"),
           F.avg(units).alias("mean_units"), F.stddev_pop(units).alias("std_units")]
    s = alloc.groupBy(*scn).agg(*agg) if scn else alloc.agg(*agg)
    return s.withColumn("budget", _lit(budget)).withColumn("usage", F.col("total_cost") / F.col("budget"))


def verify_allocation(stats: DataFrame) -> DataFrame:
    """Error above 105 %, warning below 95 %, low-variation warning (std < 1)."""
    return (stats.withColumn("error_over", F.col("usage") > 1.05)
                 .withColumn("warn_under", F.col("usage") < 0.95)
                 .withColumn("warn_low_variation", F.col("std_units") < 1.0))


def raise_if_invalid(flags: DataFrame) -> None:
    """Driver-side raise from the (one-row-per-scenario) flag table."""
    bad = flags.where(F.col("error_over")).limit(1).collect()
    if bad:
        raise ValueError(f"Budget exceeded by more than 5%: {bad[0].asDict()}")


def budget_flags(used: Column, budget: Column) -> dict[str, Column]:
    """Strict and banded checks of ``used`` against ``budget``."""
    r = used / budget
    return {
        "usage_pct": r * 100,
        "exceeded": used > budget,
        "note_under_90": r < 0.9,
        "band_10": F.when(r > 1.1, "over").when(r < 0.9, "under").otherwise("ok"),
        "band_20": F.when(r > 5, "critical").when(r > 1.2, "over").when(r < 0.8, "under").otherwise("ok"),
    }


def budget_report(target: Column, *used_candidates: Column) -> dict[str, Column]:
    """Target, used (first present of the candidates), usage %, remaining, within."""
    used = F.coalesce(*used_candidates)
    return {"target": target, "used": used, "usage_pct": used / target * 100,
            "remaining": target - used, "within_budget": used <= target}


def approx_cost(method: Column, r: Column, rf: Column, width: int) -> Column:
    """``2 r h`` (low-rank), ``2 h (h div rf)`` (adapter), their sum (hybrid)."""
    lora = 2 * r * width
    adapter = 2 * width * F.floor(F.lit(width) / rf)
    return (F.when(method == "lora", lora).when(method == "adapter", adapter)
             .when(method == "hybrid", lora + adapter)).cast("bigint")


def candidate_grid(spark, width: int, max_r: int = 64, rfs=(2, 4, 8, 16, 32, 64)) -> DataFrame:
    """Candidate configurations from a rule: ranks 1..max_r, reduction factors, hybrids."""
    r = spark.range(1, max_r + 1).select(F.col("id").cast("int").alias("r"))
    f = spark.createDataFrame([(int(x),) for x in rfs], "rf int")
    lora = r.select(F.lit("lora").alias("method"), "r", F.lit(None).cast("int").alias("rf"))
    ad = f.select(F.lit("adapter").alias("method"), F.lit(None).cast("int").alias("r"), "rf")
    hy = r.crossJoin(F.broadcast(f)).select(F.lit("hybrid").alias("method"), "r", "rf")  # both sides are rule-sized
    g = lora.unionByName(ad).unionByName(hy)
    return g.withColumn("cost", approx_cost(F.col("method"), F.col("r"), F.col("rf"), width))


def matching_configs(targets: DataFrame, target: str, grid: DataFrame, tol: float = 0.05) -> DataFrame:
    """Candidates whose cost is within ``tol`` of each target.

    A band join written as an equi-join: costs are bucketed on a log scale
    whose bucket is wider than the band, each target probes the (at most two)
    buckets its band touches, and the exact condition filters the pairs.
    """
    import math
    width = math.log((1 + tol) / (1 - tol)) * 1.01

    def bucket(x):
        return F.floor(F.ln(x) / width).cast("bigint")

    gb = grid.where(F.col("cost") > 0).withColumn("_bk", bucket(F.col("cost")))
    tb = targets.withColumn("_bk", F.explode(F.array_distinct(F.array(
        bucket(F.col(target) * (1 - tol)), bucket(F.col(target) * (1 + tol))))))
    j = tb.join(gb, "_bk").where(F.abs(F.col("cost") / F.col(target) - 1) <= tol)
    return j.drop("_bk")


def applied_audit(expected: DataFrame, applied: DataFrame, key: str, value: str = "units",
                  applied_value: str = "applied_units") -> DataFrame:
    """Expected vs applied per group: ranges, unique counts, differing
    groups, whether the applied values are all the same (critical), and
    whether the two value sets are equal."""
    j = expected.select(key, value).join(applied.select(key, applied_value), key, "full")
    return j.agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.min(value).alias("expected_min"), F.max(value).alias("expected_max"),
        F.min(applied_value).alias("applied_min"), F.max(applied_value).alias("applied_max"),
        F.count_distinct(value).alias("n_unique_expected"), F.count_distinct(applied_value).alias("n_unique_applied"),
        F.count_if(~F.col(value).eqNullSafe(F.col(applied_value))).alias("n_mismatch"),
        # distinct values only: at most max-units entries per side
        (F.array_sort(F.collect_set(value)) == F.array_sort(F.collect_set(applied_value))).alias("sets_equal"),
    ).withColumn("all_same_applied", F.col("n_unique_applied") == 1)


def issue_report(facts: DataFrame, rules: list[tuple[int, str, str, str, Column]]) -> DataFrame:
    """Evaluate rules over a one-row fact table; keep the rules that fire.

    ``rules`` = (id, severity, description, impact, condition over ``facts``).
    """
    arr = F.array(*[F.struct(F.lit(i).alias("issue_id"), F.lit(sev).alias("severity"),
                             F.lit(desc).alias("description"), F.lit(imp).alias("impact"),
                             F.coalesce(cond, F.lit(False)).alias("_fires"))
                    for i, sev, desc, imp, cond in rules])
    return (facts.select(F.explode(arr).alias("_r")).select("_r.*")
                 .where(F.col("_fires")).drop("_fires"))
