"""Two-level ranks, quotas, splits and samples: exactness and properties."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusflow.functions.hashing import hash_order, uniform
from corpusflow.operators import sampling as S
from corpusflow.operators.ranks import bucketed_running, class_rank, global_rank, ntile_from_rank, stratified_quota

from driver_tables import SF01


def _skewed(spark, n=3000):
    rnd = random.Random(1)
    # one hot class holds a third of the rows
    rows = [(i, 0 if i % 3 == 0 else rnd.randint(1, 9), rnd.randint(0, 50)) for i in range(n)]
    return spark.createDataFrame(rows, "id bigint, label int, v int")


def test_class_rank_equals_plain_window(spark):
    df = _skewed(spark)
    mine = class_rank(df, ["label"], hash_order(7, "id"), "id", bucket_hex=2)
    plain = df.withColumn("rank", F.row_number().over(
        Window.partitionBy("label").orderBy(hash_order(7, "id"), "id")).cast("bigint"))
    assert mine.exceptAll(plain).count() == 0 and plain.exceptAll(mine).count() == 0


def test_class_rank_top_n_prunes_but_is_exact(spark):
    df = _skewed(spark)
    mine = class_rank(df, ["label"], hash_order(7, "id"), "id", max_rank=5, bucket_hex=2)
    plain = df.withColumn("rank", F.row_number().over(
        Window.partitionBy("label").orderBy(hash_order(7, "id"), "id")).cast("bigint")).where("rank <= 5")
    assert mine.exceptAll(plain).count() == 0 and plain.exceptAll(mine).count() == 0


def test_global_rank_and_ntile(spark):
    df = _skewed(spark)  # v has heavy ties
    mine = global_rank(df, ["v"], "id", num_ranges=7)
    plain = df.withColumn("rank", F.row_number().over(Window.orderBy("v", "id")).cast("bigint"))
    assert mine.exceptAll(plain).count() == 0
    n = df.count()
    t = mine.withColumn("t", ntile_from_rank(F.col("rank"), F.lit(n), 3))
    ref = df.withColumn("t", F.ntile(3).over(Window.orderBy("v", "id")))
    assert t.select("id", "t").exceptAll(ref.select("id", "t")).count() == 0


def test_bucketed_running_equals_window(spark):
    df = _skewed(spark).withColumn("b", (F.col("v") / 10).cast("int"))
    mine = bucketed_running(df, ["label"], ["v", "id"], F.col("b"), value="v")
    w = Window.partitionBy("label").orderBy("v", "id")
    plain = (df.withColumn("step", F.row_number().over(w).cast("bigint"))
               .withColumn("running", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    a = mine.select("id", "step", "running")
    b = plain.select("id", "step", "running")
    assert a.exceptAll(b).count() == 0


def test_quota_matches_documented_example(spark):
    counts = spark.createDataFrame([(0, 58), (1, 341)], "label int, c long")
    q = {r.label: r.quota for r in stratified_quota(counts, "label", "c", 0.1).collect()}
    assert q == {0: 6, 1: 34}


def test_quota_one_class_and_small_class(spark):
    counts = spark.createDataFrame([(0, 1), (1, 2), (2, 97)], "label int, c long")
    q = {r.label: r.quota for r in stratified_quota(counts, "label", "c", 0.25).collect()}
    assert sum(q.values()) == 25 and q[2] >= 24
    one = spark.createDataFrame([(5, 10)], "label int, c long")
    assert stratified_quota(one, "label", "c", 0.3).collect()[0].quota == 3


def _labelled(spark):
    d = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id")
    lab = spark.read.parquet(f"{SF01}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    return d.join(lab, "doc_id")


def test_three_way_split_is_disjoint_complete_stratified(spark):
    df = _labelled(spark)
    sp = S.stratified_split3(df, "label", 0.1, 0.1, 42, "doc_id")
    assert sp.count() == df.count() == sp.select("doc_id").distinct().count()
    c = {(r.split, r.label): r["count"] for r in sp.groupBy("split", "label").count().collect()}
    held = {k: c.get(("validation", k), 0) + c.get(("test", k), 0) for k in (0, 1)}
    assert held == {0: 12, 1: 68}  # ceil(0.2 * 399) = 80 split by class share


def test_split_and_few_shot_repeatable(spark):
    df = _labelled(spark)
    a = S.few_shot(df, 16, "label", 42, "doc_id")
    b = S.few_shot(df.repartition(7), 16, "label", 42, "doc_id")
    assert a.exceptAll(b).count() == 0
    sizes = {r.label: r["count"] for r in a.groupBy("label").count().collect()}
    assert sizes == {0: 16, 1: 16}
    big = S.few_shot(df, 100, "label", 42, "doc_id")
    assert {r.label: r["count"] for r in big.groupBy("label").count().collect()} == {0: 58, 1: 100}


def test_few_shot_only_samples_train(spark):
    df = _labelled(spark).withColumn("split", F.when(F.col("doc_id") < 300, "train").otherwise("test"))
    out = S.few_shot(df, 4, "label", 1, "doc_id", split_col="split")
    assert out.where("split = 'test'").count() == df.where("split = 'test'").count()
    assert out.where("split = 'train'").count() == 8


def test_ensure_splits_errors_and_passthrough(spark):
    import pytest
    df = _labelled(spark)
    with pytest.raises(ValueError):
        S.ensure_splits(df.withColumn("split", F.lit("test")), "label", 0.1, 0.1, 42, "doc_id")
    allp = df.withColumn("split", F.element_at(F.array(F.lit("train"), F.lit("validation"), F.lit("test")),
                                                (F.col("doc_id") % 3 + 1).cast("int")))
    assert S.ensure_splits(allp, "label", 0.1, 0.1, 42, "doc_id") is allp


def test_empty_table(spark):
    e = spark.createDataFrame([], "doc_id bigint, label int")
    assert S.few_shot(e, 5, "label", 1, "doc_id").count() == 0
    assert S.stratified_split(e, "label", 0.2, 1, "doc_id").count() == 0


def test_uniform_matches_documented_value(spark):
    v = spark.range(1).select(uniform(42, F.lit(7)).alias("u")).collect()[0].u
    assert abs(v - 0.46435326454229653) < 1e-15


def test_bootstrap_mean_copies(spark):
    df = spark.range(20000).withColumnRenamed("id", "k")
    n = S.bootstrap(df, 0.2, 3, "k").count()
    assert 3600 < n < 4400


def test_select_split_errors_on_absent_split(spark):
    import pytest
    df = spark.createDataFrame([(1, "train"), (2, "test")], "doc_id long, split string")
    assert S.select_split(df, "test").count() == 1 and S.select_split(df, "all").count() == 2
    with pytest.raises(ValueError, match="Available"):
        S.select_split(df, "validation")


def test_null_labels_form_their_own_class(spark):
    rows = [(i, None if i % 4 == 0 else i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, label int")
    sp = S.stratified_split(df, "label", 0.25, 3, "doc_id")
    assert sp.count() == 40
    held = {r.label: r["count"] for r in sp.where("split = 'test'").groupBy("label").count().collect()}
    assert sum(held.values()) == 10 and held.get(None, 0) >= 2
    fs = S.few_shot(df, 3, "label", 3, "doc_id")
    assert fs.count() == 9


def test_one_class_only(spark):
    df = spark.createDataFrame([(i, 7) for i in range(10)], "doc_id long, label int")
    assert S.few_shot(df, 4, "label", 1, "doc_id").count() == 4
    sp = S.stratified_split3(df, "label", 0.2, 0.1, 1, "doc_id")
    c = {r.split: r["count"] for r in sp.groupBy("split").count().collect()}
    # 0.2 + 0.1 == 0.30000000000000004 in floating point, so ceil(0.3... * 10) = 4
    # rows are held out (as with a float test_size); test gets ceil(1/3 * 4) = 2
    assert c == {"train": 6, "validation": 2, "test": 2}


def test_within_rank_limits_equals_window(spark):
    from corpusflow.operators.ranks import within_rank_limits
    df = _skewed(spark, 4000)
    lim = df.groupBy("label").count().select("label", (F.col("count") * 0.3).cast("bigint").alias("L1"),
                                                      (F.col("count") * 0.05 + 1).cast("bigint").alias("L2"))
    x = df.join(lim, "label")
    for h1, h2 in [(1, 1), (2, 1), (3, 3)]:
        got = within_rank_limits(x, ["label"], hash_order(5, "id"), "id", ["L1", "L2"], hex1=h1, hex2=h2)
        rk = F.row_number().over(Window.partitionBy("label").orderBy(hash_order(5, "id"), "id"))
        ref = x.withColumn("_r", rk).select(*x.columns, (F.col("_r") <= F.col("L1")).alias("_le_0"),
                                            (F.col("_r") <= F.col("L2")).alias("_le_1"))
        assert got.count() == x.count()
        assert got.exceptAll(ref).count() == 0 and ref.exceptAll(got).count() == 0, (h1, h2)


def test_hot_class_is_spread_over_buckets(spark):
    """A class holding a third of the rows is ranked in (class, bucket)
    windows of about N/3/16**hex rows, not in one window."""
    n = 30000
    df = spark.range(n).select(F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 97 + 1).alias("label"))
    b = df.select("label", F.substring(hash_order(1, "id"), 1, 2).alias("b"))
    sizes = b.where("label = 0").groupBy("b").count()
    mx = sizes.agg(F.max("count")).collect()[0][0]
    assert sizes.count() == 256 and mx <= 3 * (n / 3 / 256)


def test_ensure_splits_keeps_rows_without_a_split(spark):
    df = spark.createDataFrame([(i, i % 2, "train" if i < 40 else None if i < 45 else "test") for i in range(50)],
                               "doc_id bigint, label int, split string")
    out = S.ensure_splits(df, "label", 0.1, 0.1, 1, "doc_id")
    assert out.count() == 50 and out.where("split IS NULL").count() == 5


def test_bootstrap_of_large_rates_is_not_capped(spark):
    df = spark.range(2000).withColumnRenamed("id", "doc_id")
    n = S.bootstrap(df, 50, 1, "doc_id").count()
    assert abs(n - 100_000) < 4 * (50 * 2000) ** 0.5
    assert S.poisson_cdf(0.2)[-1] > 1 - 2.0 ** -33 and S.poisson_cdf(16.0)[-1] > 1 - 1e-9
