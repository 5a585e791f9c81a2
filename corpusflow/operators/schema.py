"""Projections, lookups, defaults, config maps, timestamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Label id -> label text per dataset, and the dataset registry
# (name, hub id, hub config, text column, label column, number of labels,
# has a validation split, task type, sub-tasks).  Downloaded copies
# normalise the text column to ``text``.
LABEL_MAPS = {
    "sst2": {0: "negative", 1: "positive"},
    "ag_news": {0: "World", 1: "Sports", 2: "Business", 3: "Sci/Tech"},
    "imdb": {0: "negative", 1: "positive"},
    "tweeteval-sentiment": {0: "negative", 1: "neutral", 2: "positive"},
}

REGISTRY = [
    ("sst2", "glue", "sst2", "sentence", "label", 2, True, "sentiment", None),
    ("ag_news", "ag_news", None, "text", "label", 4, False, "topic_classification", None),
    ("imdb", "imdb", None, "text", "label", 2, False, "sentiment", None),
    ("tweet_eval", "tweet_eval", "sentiment", "text", "label", 3, True, "sentiment",
     ["emotion", "sentiment", "offensive"]),
    ("yelp", "yelp_polarity", None, "text", "label", 5, False, "sentiment", None),
]

REGISTRY_SCHEMA = ("name string, hub_id string, hub_config string, text_column string, "
                   "label_column string, num_labels int, has_validation boolean, task_type string, "
                   "subtasks array<string>")


def registry(spark) -> DataFrame:
    """The dataset registry as a small constant DataFrame."""
    return spark.createDataFrame(REGISTRY, REGISTRY_SCHEMA)


def dataset_info(spark, name: str) -> DataFrame:
    """One registry row; an unknown name raises with the available names."""
    names = [r[0] for r in REGISTRY]
    if name not in names:
        raise ValueError(f"Unknown dataset {name!r}. Available: {names}")
    return registry(spark).where(F.col("name") == name)


def normalize_schema(df: DataFrame, text_col: str | None = None, label_col: str = "label") -> DataFrame:
    """Keep exactly ``text, label`` (P1); the text column may be ``text`` or ``sentence``."""
    if text_col is None:
        text_col = "text" if "text" in df.columns else "sentence"
    return df.select(F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label"))


def rename_label(df: DataFrame, label: str = "label") -> DataFrame:
    """Rename ``label`` to ``labels`` if present and not done already."""
    if label in df.columns and "labels" not in df.columns:
        return df.withColumnRenamed(label, "labels")
    return df


def keep_model_columns(df: DataFrame, label: str = "labels") -> DataFrame:
    """Keep ``input_ids, attention_mask`` and the label; drop the complement."""
    keep = [c for c in ("input_ids", "attention_mask", label) if c in df.columns]
    return df.drop(*[c for c in df.columns if c not in keep])


def label_text(label: Column, mapping: dict[int, str] | None) -> Column:
    """Label id -> text; unmapped ids give null."""
    if not mapping:
        return F.lit(None).cast("string")
    m = F.create_map(*[x for k, v in sorted(mapping.items()) for x in (F.lit(int(k)), F.lit(v))])
    return F.try_element_at(m, label.cast("int"))


def cap_rows(df: DataFrame, n: int | None, order: list[str]) -> DataFrame:
    """First ``min(n, rows)`` rows by ``order``; ``n <= 0`` or None keeps all (P5)."""
    if n is None or n <= 0:
        return df
    return df.orderBy(*order).limit(n)


def split_by_contains(df: DataFrame, col: str, s: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``col`` contains ``s`` and the rest."""
    m = F.col(col).contains(s)
    return df.where(m), df.where(~m | F.col(col).isNull())


def extract_int(c: Column, pattern: str, group: int = 1) -> Column:
    """Integer captured by ``pattern``; no match gives null."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit("")).try_cast("int")


def name_matches(c: Column, keywords: list[str], not_suffix: str | None = None) -> Column:
    """Any keyword contained in ``lower(c)``, optionally excluding a suffix."""
    low = F.lower(c)
    m = F.exists(F.array(*[F.lit(k.lower()) for k in keywords]), lambda k: F.instr(low, k) > 0)
    if not_suffix:
        m = m & ~low.endswith(not_suffix.lower())
    return m


def with_default(c: Column, *fallbacks) -> Column:
    """First non-null of the column and its fallbacks (P10)."""
    return F.coalesce(c, *[f if isinstance(f, Column) else F.lit(f) for f in fallbacks])


def json_field(c: Column, path: str, cast: str | None = None) -> Column:
    """Optional field of a JSON string; missing -> null."""
    v = F.get_json_object(c, path)
    return v.try_cast(cast) if cast else v


def merge_config(*layers: Column) -> Column:
    """Layered map merge like a dict merge ``{**g, **b, **e}`` (P13): a later
    layer wins even when its value is null, keys keep the position of their
    first appearance, then null-valued keys are dropped.  Built from the key
    arrays, so no duplicate keys ever reach ``map_concat`` (no dedup setting)."""
    keys = F.array_distinct(F.concat(*[F.map_keys(x) for x in layers]))

    def value(k):
        out = None  # the last layer that has the key decides, even with a null value
        for layer in reversed(layers):
            has = F.array_contains(F.map_keys(layer), k)
            out = F.when(has, F.element_at(layer, k)) if out is None else out.when(has, F.element_at(layer, k))
        return out

    merged = F.map_from_arrays(keys, F.transform(keys, value))
    return F.map_filter(merged, lambda k, v: v.isNotNull())


# Config keys that are not command-line arguments
NOT_ARGS = ["name", "description", "experiments", "base_config"]


def flatten_config(cfg: Column, exclude: list[str] | None = None) -> Column:
    """Command-line tokens from a merged config (P14), in key order.

    Values are JSON text: ``true``/``false`` (flag / dropped), ``[..]`` lists
    (``--key v1 v2``; an empty top-level list is dropped), ``{..}`` nested
    configs flattened one level with their own keys (``--sub v``; nested
    nulls dropped, nested lists kept even when empty), anything else
    ``--key value``.  Excluded keys and null values are skipped.
    """
    ex = F.array(*[F.lit(k) for k in (NOT_ARGS if exclude is None else exclude)])
    kept = F.map_filter(cfg, lambda k, v: ~F.array_contains(ex, k) & v.isNotNull())
    entries = F.map_entries(kept)

    def scalar(name, v, top: bool):
        flag = F.concat(F.lit("--"), name)
        lst = F.from_json(v, "array<string>")
        as_list = F.concat(F.array(flag), lst)
        if top:
            as_list = F.when(F.size(lst) > 0, as_list).otherwise(F.array().cast("array<string>"))
        return (F.when(F.lower(v) == "true", F.array(flag))
                 .when(F.lower(v) == "false", F.array().cast("array<string>"))
                 .when(F.trim(v).startswith("["), as_list)
                 .otherwise(F.array(flag, F.regexp_replace(v, '^"|"$', ""))))

    def one(e):
        k, v = e["key"], e["value"]
        nested = F.map_entries(F.map_filter(F.from_json(v, "map<string,string>"), lambda a, b: b.isNotNull()))
        flat_nested = F.flatten(F.transform(nested, lambda x: scalar(x["key"], x["value"], False)))
        return F.when(F.trim(v).startswith("{"), flat_nested).otherwise(scalar(k, v, True))

    return F.flatten(F.transform(entries, one))


def iso_string(ts: Column) -> Column:
    """ISO-8601 string with microseconds."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def file_stamp(ts: Column) -> Column:
    """``%Y%m%d_%H%M%S`` file-name suffix."""
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def seconds_between(start: Column, end: Column) -> Column:
    """``end - start`` in seconds, microsecond precision."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1e6)


def union_tolerant(a: DataFrame, b: DataFrame) -> DataFrame:
    """Bag union by name; a column missing on one side is null there."""
    return a.unionByName(b, allowMissingColumns=True)


def set_diff(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """Distinct values in one side only, with the side they are missing from."""
    x = a.select(col).distinct()
    y = b.select(col).distinct()
    return (x.exceptAll(y).withColumn("missing_from", F.lit("second"))
            .unionByName(y.exceptAll(x).withColumn("missing_from", F.lit("first"))))
