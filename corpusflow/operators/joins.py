"""Lookups and matching loops expressed as joins.

Theta joins on substrings are rewritten as equi-joins: an index of character
grams is probed (or the numeric token is parsed), so Spark can use a hash or
sort-merge join instead of a nested loop or a cross product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.operators.ranks import bounded_broadcast
from corpusflow.session import checkpoint_dir


def characters(s: Column) -> Column:
    """The code points of a string."""
    return F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0))


def qgrams(chars: Column, q: int) -> Column:
    """Distinct runs of ``q`` of the characters (none where there are fewer)."""
    n = F.size(chars)
    # characters are reached by place, so the grams of a long name cost their number
    grams = F.transform(F.sequence(F.lit(0), n - q), lambda i: F.concat(*[F.get(chars, i + k) for k in range(q)]))
    return F.array_distinct(F.when(n >= q, grams).otherwise(F.array().cast("array<string>")))


def _materialised(df: DataFrame) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def substring_pairs(texts: DataFrame, patterns: DataFrame, q: int = 3) -> DataFrame:
    """Pairs ``(tid, pid)`` such that the text (``tid``, ``t``) contains the pattern (``pid``, ``p``, not empty).

    An inverted index names the texts of every gram that some pattern has.  A pattern asks it for its rarest gram
    only (its ``q`` characters that the fewest texts have, or itself where it is shorter), and what that returns is
    verified.  The index holds ids; strings meet at the end, for the candidates.
    """
    chars = patterns.select("pid", "p", characters(F.col("p")).alias("_c"))
    grams = F.when(F.size("_c") < q, F.array("p")).otherwise(qgrams(F.col("_c"), q))
    asked = _materialised(chars.select("pid", F.explode(grams).alias("g")))
    needed = bounded_broadcast(asked.select("g").distinct())
    of_text = texts.select("tid", characters(F.col("t")).alias("_c"))
    # shorter grams serve patterns that are shorter themselves
    every = F.flatten(F.array(*[qgrams(F.col("_c"), k) for k in range(1, q + 1)]))
    index = _materialised(of_text.select("tid", F.explode(every).alias("g")).join(needed, "g", "left_semi"))
    spread = index.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    # a pattern with a gram that no text has drops out: its rarest gram is in no text
    rarest = asked.join(spread, "g", "left").groupBy("pid").agg(F.min_by("g", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g")).alias("g"))
    candidates = rarest.join(index, "g").select("tid", "pid")
    met = candidates.join(patterns.select("pid", "p"), "pid").join(texts.select("tid", "t"), "tid")
    return met.where(F.contains("t", "p")).select("tid", "pid")


def strip_affixes(c: Column, prefixes: list[str], suffixes: list[str]) -> Column:
    """Remove fixed prefixes / suffixes (each at most once, in the given order)."""
    for p in prefixes:
        c = F.when(c.startswith(p), F.substring(c, len(p) + 1, 1 << 30)).otherwise(c)
    for s in suffixes:
        c = F.when(c.endswith(s), F.left(c, F.length(c) - len(s))).otherwise(c)
    return c


def remove_substrings(c: Column, parts: list[str]) -> Column:
    """Remove every occurrence of each fixed fragment, in the given order
    (how parameter names are reduced to their core module path before J3)."""
    for x in parts:
        c = F.replace(c, F.lit(x), F.lit(""))
    return c


def contains_first_match(a: DataFrame, a_col: str, b: DataFrame, b_col: str, pos: str,
                         out: str = "match", q: int = 3) -> DataFrame:
    """For each ``a`` value, the ``b`` value with the smallest ``pos`` (ties: the smaller value) such that
    ``a`` contains ``b`` or ``b`` contains ``a`` (J3); no match or a null value -> null.

    Both directions are index joins (``substring_pairs``), so neither side is paired with all of the other and
    names may be long.  The empty string is part of every other.  ``min_by`` picks the first match as a partial
    aggregate.
    """
    av = _materialised(a.select(F.col(a_col).alias("_a")).distinct().withColumn("_ai", F.monotonically_increasing_id()))
    bv = b.where(F.col(b_col).isNotNull()).groupBy(F.col(b_col).alias("_bv")).agg(F.min(pos).alias("_pos"))
    bv = _materialised(bv.withColumn("_bi", F.monotonically_increasing_id()))
    am, bm = av.where(F.length("_a") > 0), bv.where(F.length("_bv") > 0)
    b_in_a = substring_pairs(am.select(F.col("_ai").alias("tid"), F.col("_a").alias("t")), bm.select(F.col("_bi").alias("pid"), F.col("_bv").alias("p")), q)
    a_in_b = substring_pairs(bm.select(F.col("_bi").alias("tid"), F.col("_bv").alias("t")), am.select(F.col("_ai").alias("pid"), F.col("_a").alias("p")), q)
    pairs = b_in_a.select(F.col("tid").alias("_ai"), F.col("pid").alias("_bi")).unionByName(a_in_b.select(F.col("pid").alias("_ai"), F.col("tid").alias("_bi")))
    rank = F.struct(F.col("_pos"), F.col("_bv").alias("_v"))
    best = pairs.join(bv, "_bi").groupBy("_ai").agg(F.min(rank).alias("_found"))
    # one row: the first of all values (for an empty a) and the empty one, if there is one (for every a)
    first = bv.agg(F.min(rank).alias("_any"), F.min(F.when(F.length("_bv") == 0, rank)).alias("_blank"))
    j = av.join(best, "_ai", "left").crossJoin(F.broadcast(first))
    found = F.when(F.col("_a") == "", F.col("_any")).when(F.col("_a").isNotNull(), F.least("_found", "_blank"))
    return j.select(F.col("_a").alias(a_col), found["_v"].alias(out))


def layer_token_join(modules: DataFrame, name: str, groups: DataFrame, layer: str, pos: str,
                     keywords: list[str], value: str, out: str = "assigned") -> DataFrame:
    """Assign each module the value of the **last** group (by ``pos``) whose
    token ``layer.<n>.`` occurs in the module name, among names that contain a
    target keyword (J4).  The token is parsed with a regex on the module side,
    so the theta join becomes an equi-join on ``n``."""
    low = F.lower(F.col(name))
    kw = F.exists(F.array(*[F.lit(k) for k in keywords]), lambda k: F.instr(low, k) > 0)
    m = (modules.where(kw)
         .select(name, F.explode(F.array_distinct(
             F.regexp_extract_all(F.col(name), F.lit(r"layer\.(\d+)\."), 1))).alias("_n")))
    g = groups.select(F.col(layer).cast("string").alias("_n"), F.col(pos).alias("_pos"), F.col(value).alias("_v"))
    j = m.join(g, "_n")
    return j.groupBy(name).agg(F.max_by(F.struct(F.col("_n").cast("int").alias("layer"), F.col("_v").alias(out)),
                                        "_pos").alias("_w")).select(name, "_w.*")


def unmatched(left: DataFrame, right: DataFrame, on) -> DataFrame:
    """Rows of ``left`` with no partner in ``right``."""
    return left.join(right, on, "left_anti")


def match_audit(left: DataFrame, right: DataFrame, key: str, by: str) -> DataFrame:
    """Matched / missing counts per group and a success flag (J6):
    success iff nothing is missing and at least one row matched."""
    r = right.select(key).distinct().withColumn("_hit", F.lit(True))
    j = left.join(r, key, "left")
    agg = j.groupBy(by).agg(F.count_if(F.col("_hit").isNotNull()).alias("n_matched"),
                            F.count_if(F.col("_hit").isNull()).alias("n_missing"))
    return agg.withColumn("success", (F.col("n_missing") == 0) & (F.col("n_matched") >= 1))


def template_grid(spark, templates: list[tuple[str, str]], values: dict[str, list]) -> DataFrame:
    """Expand sweep templates (J9/E13): every template crossed with every value
    of its placeholder, ``{n}`` style names filled in."""
    rows = []
    for tmpl, ph in templates:
        for v in values[ph]:
            rows.append((tmpl, ph, str(v)))
    return (spark.createDataFrame(rows, "template string, placeholder string, value string")
            .withColumn("name", F.expr("replace(template, concat('{', placeholder, '}'), value)")))


def keyed_bag_cosine(df: DataFrame, key: str, a: Column, b: Column, out: str = "cosine") -> DataFrame:
    """Cosine of the term-count vectors of two token arrays held by the
    same row (a text and its augmentation), for every ``key``.

    The pair is keyed: rows are hash-partitioned by ``key`` once (each row
    moves once; keys are unique, so no skew), then each side is exploded
    with a literal side tag (no per-element lambda), counted per
    (key, term) and reduced per key.  Both aggregations are satisfied by the
    key partitioning, so they run without further shuffles.  Nothing pairs
    different keys.  Null when a side has no tokens.
    """
    df = df.repartition(key)
    sa = df.select(key, F.explode_outer(a).alias("t"), F.lit(1).alias("x"), F.lit(0).alias("y"))
    sb = df.select(key, F.explode_outer(b).alias("t"), F.lit(0).alias("x"), F.lit(1).alias("y"))
    c = (sa.unionByName(sb).groupBy(key, "t")
           .agg(F.sum(F.when(F.col("t").isNotNull(), F.col("x"))).alias("ca"),
                F.sum(F.when(F.col("t").isNotNull(), F.col("y"))).alias("cb")))
    per = c.groupBy(key).agg(F.sum(F.col("ca") * F.col("cb")).alias("_ab"), F.sum(F.col("ca") * F.col("ca")).alias("_aa"),
                             F.sum(F.col("cb") * F.col("cb")).alias("_bb"))
    cos = F.try_divide(F.col("_ab").cast("double"), F.sqrt(F.col("_aa").cast("double")) * F.sqrt(F.col("_bb").cast("double")))
    return per.select(key, cos.alias(out))
