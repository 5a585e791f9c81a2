"""Substring join by an n-gram index (J3) and exact sampling with replacement."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from corpusflow.operators.joins import characters, contains_first_match, qgrams
from corpusflow.operators.sampling import sample_with_replacement


def first_match(a, bs):
    """The double loop: the first b (by position, then value) that contains a or stands in it."""
    if a is None:
        return None
    return next((b for _, b in sorted(bs) if b in a or a in b), None)


def run(spark, a, bs, **options):
    # what is long is made by Spark, so the rows stay small on their way there
    A = spark.createDataFrame([(x,) for x in a], "name string").repartition(3)
    B = spark.createDataFrame([(p, v) for p, v in bs], "pos int, v string").withColumn("_a", F.lit("clash"))
    return {r["name"]: r["match"] for r in contains_first_match(A, "name", B, "v", "pos", **options).collect()}


@pytest.mark.parametrize("seed, letters, q", [(1, "ab", 3), (2, "abcdé日😀 ", 3), (3, "ab.", 2), (4, "abc", 1), (5, "abc", 5)])
def test_equal_to_the_double_loop(spark, seed, letters, q):
    random.seed(seed)
    def word(n):
        return "".join(random.choice(letters) for _ in range(random.randint(0, n)))
    a = [word(12) for _ in range(60)] + [None, "", letters[0]]
    bs = [(random.randint(0, 5), word(9)) for _ in range(60)]
    bs = [x for x in bs if x[1]]  # without the empty string first
    for some in (bs, [*bs, (3, "")]):
        assert run(spark, a, some, q=q) == {x: first_match(x, some) for x in a}


def test_long_names_and_common_grams(spark):
    random.seed(6)
    long = ["".join(random.choices("abcdefgh", k=10_000)) for _ in range(6)]
    a = [*long, "ab" * 5000, "zz", long[2][4000:4100]]
    bs = [(9, long[0][5000:5060]), (2, long[1][9990:]), (1, "ab" * 3000), (7, "q"), (8, "zzz"), (4, long[3] + "x"), (3, long[2] + "y")]
    got = run(spark, a, bs)
    assert got == {x: first_match(x, bs) for x in a}


def test_no_rows(spark):
    assert run(spark, ["x", ""], []) == {"x": None, "": None}
    assert run(spark, [], [(1, "x")]) == {}


def test_grams_are_of_code_points(spark):
    r = spark.createDataFrame([("a😀b日\nb",)], "s string").select(qgrams(characters(F.col("s")), 2).alias("g")).first()
    assert sorted(r["g"]) == sorted(["a😀", "😀b", "b日", "日\n", "\nb"])


def test_no_nested_loop_over_names(spark):
    A = spark.createDataFrame([("abc",)], "name string")
    B = spark.createDataFrame([(1, "b")], "pos int, v string")
    plan = contains_first_match(A, "name", B, "v", "pos")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastNestedLoopJoin") == 1 and "CartesianProduct" not in plan  # the one row of first values


@pytest.mark.parametrize("n", [0, 1, 37, 4000])
def test_draws_with_replacement_are_exact(spark, n):
    df = spark.range(500).withColumn("x", F.lit("a"))
    got = [sorted((r["id"], r["times"]) for r in sample_with_replacement(d, n, 7, "id").collect()) for d in (df, df.repartition(9), df.coalesce(1))]
    assert got[0] == got[1] == got[2] and sum(t for _, t in got[0]) == n
    if n == 4000:  # eight each on average
        times = collections.Counter(dict(got[0]))
        mean = sum((times[i] - 8) ** 2 for i in range(500)) / 500
        assert 6.4 < mean < 9.6 and len(times) >= 495


def test_no_rows_give_no_draws(spark):
    assert sample_with_replacement(spark.range(0), 10, 7, "id").count() == 0
