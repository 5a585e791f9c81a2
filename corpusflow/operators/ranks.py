"""Exact ranks that never put a whole class (or the whole table) in one task.

``row_number() over (partition by label order by h)`` sends every row of a
class to a single task; with one class holding a third of the data that task
is the job.  The ranks here compute the same numbers in two passes:

* ``class_rank`` (hash order inside a group): split every group into up to
  ``16**bucket_hex`` buckets (default 16**5, about a million) by the leading
  hex digits of the md5 order key.
  Bucket sizes form a small table; a running sum over it gives each bucket's
  offset, and the final rank is ``offset + row_number() over (group, bucket)``.
  Because the order key starts with the bucket digits, bucket order is rank
  order.  With ``max_rank`` (top-n per group) buckets that start past ``n``
  are dropped before the window, so only about ``n`` rows per group are sorted.

* ``global_rank`` (value order over the whole table): range-partition on
  ``(value..., key)`` (Spark samples the composite key, so heavy ties in the
  value are split by the key), checkpoint that assignment, count rows per
  range, and add each range's offset to the row number inside the range.
  The offset table has one row per range, so broadcasting it is bounded by
  ``num_ranges``.

* ``within_rank_limits`` answers only "rank <= L" (what a split needs):
  buckets wholly before or after a limit are decided from the offset table,
  and only the straddling (sub-)bucket is ranked, so the bulk of the rows
  never reaches a shuffle.

* ``segmented_scan`` (ranks, running sums and totals per group in any order):
  range-partition by group and order, and carry what a range starts from over
  a table of two rows a range.

* ``bucketed_running`` ranks and running sums per group for an order with a
  monotone bucket (hour of a timestamp), split the same way.

``stratified_quota`` turns class counts into per-class quotas with the
largest-remainder rule used by stratified splits; ``bounded_broadcast``
materialises a group-level table and broadcasts it after a size check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cols(cs):
    return [F.col(c) if isinstance(c, str) else c for c in cs]


def class_rank(df: DataFrame, by: list[str], order: Column, key: str,
               out: str = "rank", max_rank: int | None = None,
               bucket_hex: int = 5, limit_col: str | None = None) -> DataFrame:
    """``row_number() over (partition by *by order by order, key)`` in two passes.

    ``order`` must be an md5 hex string (see ``functions.hashing.hash_order``)
    so that its first ``bucket_hex`` characters are uniform buckets.
    ``max_rank`` keeps only rows with rank <= max_rank (pruning whole buckets
    before the row-level window).  ``limit_col`` names a column of ``df`` that
    is constant within a group and gives that group's own limit.
    """
    h = df.withColumn("_h", order).withColumn("_b", F.substring("_h", 1, bucket_hex))
    if limit_col is not None:
        h = h.withColumn("_lim", F.col(limit_col))
        max_rank = F.col("_lim")
    sizes = h.groupBy(*by, *(["_lim"] if limit_col else []), "_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)).cast("bigint"))
    if max_rank is not None:
        offs = offs.where(F.col("_off") < max_rank)
        if limit_col is not None:
            offs = offs.drop("_lim")
    offs = offs.select(*[F.col(c).alias(f"_k_{c}") for c in by], F.col("_b").alias("_kb"), "_off")
    if max_rank is not None:
        # pruned to the buckets that hold the first max_rank rows of each
        # group: materialise it and broadcast after a size check, so the rows
        # meet it map-side and only the kept rows reach the window shuffle
        offs = bounded_broadcast(offs)
    cond = F.col("_b") == F.col("_kb")
    for c in by:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    j = h.join(offs, cond, "inner").drop(*[f"_k_{c}" for c in by], "_kb")
    w2 = Window.partitionBy(*by, "_b").orderBy("_h", key)
    r = j.withColumn(out, (F.col("_off") + F.row_number().over(w2)).cast("bigint"))
    if max_rank is not None:
        r = r.where(F.col(out) <= max_rank)
    return r.drop("_h", "_b", "_off", "_lim")


def global_rank(df: DataFrame, order: list, key: str, out: str = "rank",
                num_ranges: int | None = None, materialize_input: bool = True) -> DataFrame:
    """``row_number() over (order by *order, key)`` without a single-task window.

    The range bounds Spark samples are seeded by the RDD id, so two plan
    branches over the same ``repartitionByRange`` may disagree on which range
    a row is in.  The range assignment is therefore materialised once with a
    reliable ``checkpoint()`` (in ``spark.checkpoint.dir``), and both the range
    sizes and the in-range row numbers read that copy.  Pass only the columns
    you need: they are what gets written.
    """
    from corpusflow.session import checkpoint_dir
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = num_ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = _cols(order) + [F.col(key)]
    if materialize_input:
        # the range sampler evaluates the input once and the shuffle again;
        # for an expensive input (e.g. regex over texts) write it once first
        df = df.checkpoint(eager=True)
    ranged = (df.repartitionByRange(n, *keys).withColumn("_p", F.spark_partition_id())
                .checkpoint(eager=True))
    sizes = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    # one row per range (<= n rows): a bounded table, so the global window and
    # the broadcast below are both sized by the parameter, not by the data.
    wo = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offs = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(wo), F.lit(0)).cast("bigint"))
    j = ranged.join(F.broadcast(offs.select("_p", "_off")), "_p")
    w = Window.partitionBy("_p").orderBy(*keys)
    return j.withColumn(out, (F.col("_off") + F.row_number().over(w)).cast("bigint")).drop("_p", "_off")


def ntile_from_rank(rank: Column, n_total: Column, k: int) -> Column:
    """``ntile(k)`` from a 1-based rank and the row count (first N mod k tiles one larger)."""
    q = F.floor(n_total / k)
    r = n_total % k
    big = r * (q + 1)  # rows covered by the larger tiles
    return F.when(rank <= big, F.ceil(rank / (q + 1))).otherwise(
        r + F.ceil((rank - big) / F.greatest(q, F.lit(1)))).cast("int")


def stratified_quota(counts: DataFrame, label: str, count_col: str, frac) -> DataFrame:
    """Per-class quota of a stratified hold-out of ``frac`` of the rows.

    ``T = ceil(frac * N)``; each class gets ``floor(T*c/N)`` and the remaining
    ``T - sum`` units go one each to the largest remainders (ties: smaller
    label).  ``counts`` has one row per class, so its windows are class-sized.
    """
    allw = Window.partitionBy()
    c = (counts
         .withColumn("_N", F.sum(count_col).over(allw))
         .withColumn("_T", F.ceil(F.lit(float(frac)) * F.col("_N")).cast("bigint"))
         .withColumn("_base", F.floor(F.col("_T") * F.col(count_col) / F.col("_N")).cast("bigint"))
         .withColumn("_rem", (F.col("_T") * F.col(count_col)) % F.col("_N"))
         .withColumn("_extra", F.col("_T") - F.sum("_base").over(allw)))
    wr = Window.orderBy(F.col("_rem").desc(), F.col(label).asc())
    c = c.withColumn("_ri", F.row_number().over(wr))
    return (c.withColumn("quota", (F.col("_base") + F.when(F.col("_ri") <= F.col("_extra"), 1).otherwise(0)).cast("bigint"))
             .drop("_N", "_T", "_base", "_rem", "_extra", "_ri"))


def bucketed_running(df: DataFrame, by: list[str], order: list, bucket: Column,
                     value: str | None = None, rank_out: str = "step",
                     sum_out: str = "running") -> DataFrame:
    """Rank (and optional running sum of ``value``) inside each group, ordered
    by ``order``, computed per ``(group, bucket)`` plus bucket offsets.

    ``bucket`` must be non-decreasing in ``order`` within a group (for example
    the day of a timestamp when ordering by the timestamp).  A group with a
    third of all rows is then spread over its buckets instead of one task.
    """
    b = df.withColumn("_bk", bucket)
    aggs = [F.count(F.lit(1)).alias("_n")]
    if value is not None:
        aggs.append(F.sum(value).alias("_s"))
    sizes = b.groupBy(*by, "_bk").agg(*aggs)
    w = Window.partitionBy(*by).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    offs = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)).cast("bigint"))
    if value is not None:
        offs = offs.withColumn("_soff", F.coalesce(F.sum("_s").over(w), F.lit(0)))
    keep = ["_off"] + (["_soff"] if value is not None else [])
    offs = offs.select(*[F.col(c).alias(f"_k_{c}") for c in by], F.col("_bk").alias("_kbk"), *keep)
    cond = F.col("_bk").eqNullSafe(F.col("_kbk"))
    for c in by:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    j = b.join(offs, cond).drop(*[f"_k_{c}" for c in by], "_kbk")
    wr = Window.partitionBy(*by, "_bk").orderBy(*_cols(order))
    j = j.withColumn(rank_out, (F.col("_off") + F.row_number().over(wr)).cast("bigint"))
    if value is not None:
        ws = wr.rowsBetween(Window.unboundedPreceding, 0)
        j = j.withColumn(sum_out, F.col("_soff") + F.sum(value).over(ws))
    return j.drop("_bk", *keep)


def segmented_scan(df: DataFrame, by: list[str], order: list, value: str | None = None, rank_out: str = "step",
                   sum_out: str = "running", total_out: str | None = None, num_ranges: int | None = None) -> DataFrame:
    """Rank, running sum of ``value`` and (``total_out``) row count of every group, ordered by ``order`` inside it.

    Rows are range-partitioned by group and order together, so a group that holds a third of them, even at one
    moment, lies in as many ranges as its rows need.  Only the first and the last group of a range can go on
    beyond it: their partial counts and sums (two rows a range at most) give what each range starts from, and are
    broadcast, bounded by ``num_ranges``.  Inside a range a window runs per (range, group).

    ``order`` should be unique in a group: rows equal in it cannot be divided.  Null groups are a group.  The
    range assignment is written once (see ``global_rank``), so pass only the columns you need.
    """
    from corpusflow.session import checkpoint_dir
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = num_ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if not by:
        one = segmented_scan(df.withColumn("_one", F.lit(0)), ["_one"], order, value, rank_out, sum_out, total_out, n)
        return one.drop("_one")
    ranged = (df.repartitionByRange(n, *[F.col(c) for c in by], *_cols(order)).withColumn("_p", F.spark_partition_id())
                .checkpoint(eager=True))
    group = F.struct(*by)
    edges = ranged.groupBy("_p").agg(F.min(group).alias("_lo"), F.max(group).alias("_hi"))
    aggs = [F.count(F.lit(1)).alias("_n")] + ([F.sum(value).alias("_s")] if value is not None else [])
    parts = (ranged.join(F.broadcast(edges), "_p").where(group.eqNullSafe(F.col("_lo")) | group.eqNullSafe(F.col("_hi")))
                   .groupBy("_p", *by).agg(*aggs))
    before = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offs = parts.select("_p", *by, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
                        F.sum("_n").over(Window.partitionBy(*by)).alias("_all"),
                        *([F.sum("_s").over(before).alias("_soff")] if value is not None else [])).checkpoint(eager=True)
    offs = offs.select(F.col("_p").alias("_kp"), *[F.col(c).alias(f"_k_{c}") for c in by], "_off", "_all", *(["_soff"] if value is not None else []))
    cond = F.col("_p") == F.col("_kp")
    for c in by:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    j = ranged.join(F.broadcast(offs), cond, "left")
    w = Window.partitionBy("_p", *by).orderBy(*_cols(order))
    out = [F.col(c) for c in df.columns]
    out.append((F.coalesce("_off", F.lit(0)) + F.row_number().over(w)).cast("bigint").alias(rank_out))
    if value is not None:
        inside = F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
        # sums are null until a value comes, as they are over the whole group
        out.append(F.when(F.col("_soff").isNull(), inside).when(inside.isNull(), F.col("_soff")).otherwise(F.col("_soff") + inside).alias(sum_out))
    if total_out is not None:
        out.append(F.coalesce("_all", F.count(F.lit(1)).over(Window.partitionBy("_p", *by))).cast("bigint").alias(total_out))
    return j.select(*out)


# broadcast a checkpointed group-level table only below this many bytes
BROADCAST_BYTES = 64 << 20


def _offsets(sizes: DataFrame, by: list[str], bucket: str, base: Column | None) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    off = F.coalesce(F.sum("_n").over(w), F.lit(0)).cast("bigint")
    return sizes.withColumn("_off", off if base is None else base + off)


def _states(limit_cols: list[str]) -> list[Column]:
    # 2 = the whole bucket is within the limit, 0 = none of it, 1 = straddles
    return [F.when(F.col("_off") + F.col("_n") <= F.col(L), 2).when(F.col("_off") >= F.col(L), 0)
             .otherwise(1).alias(f"_st_{i}") for i, L in enumerate(limit_cols)]


def table_bytes(df: DataFrame) -> int:
    """Bytes of a table's rows: 16 a row, 8 a field, and what its texts and nested values hold."""
    size = F.lit(16 + 8 * len(df.columns))
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(name), F.lit(0))
        elif kind.startswith(("array", "map", "struct")):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(name))), F.lit(0))
    return df.agg(F.coalesce(F.sum(size.cast("bigint")), F.lit(0))).first()[0]


def bounded_broadcast(small: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Materialise a group-level table (reliable checkpoint) and mark it for
    broadcast only after its size is checked against ``max_bytes``; larger
    tables are left to the planner."""
    from corpusflow.session import checkpoint_dir
    checkpoint_dir(small.sparkSession)
    small = small.checkpoint(eager=True)
    return F.broadcast(small) if table_bytes(small) <= max_bytes else small


_small = bounded_broadcast


def _key_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    ren = small.select(*[F.col(c).alias(f"_k_{c}") if c in keys else F.col(c) for c in small.columns])
    cond = None
    for c in keys:
        e = F.col(c).eqNullSafe(F.col(f"_k_{c}"))
        cond = e if cond is None else cond & e
    return big.join(ren, cond, how).drop(*[f"_k_{c}" for c in keys])


def within_rank_limits(df: DataFrame, by: list[str], order: Column, key: str, limits,
                       hex1: int = 3, hex2: int = 3, prefix: str = "_le_") -> DataFrame:
    """Add booleans ``{prefix}{i}`` = ``rank <= L_i`` where rank is
    ``row_number() over (partition by *by order by order, key)``, without
    ranking every row.

    ``limits`` is either a list of column names of ``df`` (constant within a
    group) or a function from the group sizes ``(*by, _c)`` to a table
    ``(*by, L_0, L_1, ...)``; the function form derives the limits from the
    bucket sizes already being counted, so no extra pass over the data.

    Buckets (first ``hex1`` hex digits of the md5 order) that lie wholly
    before a limit are in, wholly after are out; a bucket that straddles one
    is refined by the next ``hex2`` digits, and only rows of straddling
    sub-buckets are ranked with a window.  Both offset tables are group-level
    (checkpointed, broadcast after a row-count check), so the rows flow
    through map-side joins and only the boundary rows reach a shuffle.
    """
    from corpusflow.session import checkpoint_dir
    checkpoint_dir(df.sparkSession)
    h = df.withColumn("_h", order).withColumn("_b1", F.substring("_h", 1, hex1)) \
          .withColumn("_b2", F.substring("_h", 1 + hex1, hex2))
    if callable(limits):
        s1 = h.groupBy(*by, "_b1").agg(F.count(F.lit(1)).alias("_n"))
        counts = s1.groupBy(*by).agg(F.sum("_n").alias("_c"))
        lim = limits(counts)
        limit_cols = [c for c in lim.columns if c not in by]
        s1 = _key_join(s1, lim, list(by))
        base_cols = list(df.columns)
    else:
        limit_cols = list(limits)
        s1 = h.groupBy(*by, *limit_cols, "_b1").agg(F.count(F.lit(1)).alias("_n"))
        base_cols = [c for c in df.columns if c not in limit_cols]
        h = h.drop(*limit_cols)  # they come back with the offset table
    n = len(limit_cols)
    o1 = _small(_offsets(s1, by, "_b1", None).select(*by, "_b1", "_off", *limit_cols, *_states(limit_cols)))
    j1 = _key_join(h, o1, [*by, "_b1"])

    def any_state(prefix_st: str) -> Column:
        c = F.lit(False)
        for i in range(n):
            c = c | (F.col(f"{prefix_st}{i}") == 1)
        return c

    # level 2, on the rows of straddling buckets only (a small aggregate)
    p = j1.where(any_state("_st_")).withColumnRenamed("_off", "_off1")
    s2 = p.groupBy(*by, *limit_cols, "_b1", "_off1", "_b2").agg(F.count(F.lit(1)).alias("_n"))
    o2 = _offsets(s2, [*by, "_b1"], "_b2", F.col("_off1")).select(
        *by, "_b1", "_b2", F.col("_off").alias("_off2"),
        *[c.alias(f"_s2_{i}") for i, c in enumerate(_states(limit_cols))])
    j2 = _key_join(j1, _small(o2), [*by, "_b1", "_b2"], "left")
    j2 = j2.select("*", *[F.coalesce(f"_s2_{i}", f"_st_{i}").alias(f"_fs_{i}") for i in range(n)])
    straddle = any_state("_fs_")
    keep = base_cols + ([] if callable(limits) else limit_cols)

    settled = j2.where(~straddle).select(
        *keep, *[(F.col(f"_fs_{i}") == 2).alias(f"{prefix}{i}") for i in range(n)])
    rest = j2.where(straddle)
    w = Window.partitionBy(*by, "_b1", "_b2").orderBy("_h", key)
    rest = rest.withColumn("_rk", F.col("_off2") + F.row_number().over(w))
    ranked = rest.select(*keep, *[F.when(F.col(f"_fs_{i}") == 1, F.col("_rk") <= F.col(L))
                                   .otherwise(F.col(f"_fs_{i}") == 2).alias(f"{prefix}{i}")
                                   for i, L in enumerate(limit_cols)])
    return settled.unionByName(ranked)
