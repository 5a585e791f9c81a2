"""Text cleaning, encoding and metrics on tiny inputs."""

import pytest
from pyspark.sql import functions as F

from corpusflow.functions import text as X
from corpusflow.operators import encode as EN
from corpusflow.operators import metrics as M
from corpusflow.operators.curriculum import label_smoothing, softmax


def test_clean_text_order_and_one_pass(spark):
    df = spark.createDataFrame([(1, "&amp;lt;b&amp;gt; Hi&nbsp;@josé  see http://x.y/z <i>now</i> &quot;ok&quot;"),
                                (2, None), (3, "")], "id int, text string")
    out = {r.id: r.c for r in df.select("id", X.clean_text(F.col("text")).alias("c")).collect()}
    assert out[1] == '&lt;b&gt; Hi [USER] see [URL] now "ok"'
    assert out[2] is None and out[3] == ""


def test_full_unescape_by_name(spark):
    df = spark.createDataFrame([("&#8364; &eacute; &amp;lt;",)], "t string")
    assert df.select(X.html_unescape_full("t").alias("u")).collect()[0].u == "€ é &lt;"


def test_encode_fixed_length_and_edges(spark):
    docs = spark.createDataFrame([(1, "This is positive."), (2, "This is negative."), (3, ""), (4, None),
                                  (5, " ".join(["word"] * 300))], "id long, text string")
    vocab = EN.build_vocab(docs, "text", 10)
    enc = {r.id: r for r in EN.encode(docs, "id", "text", vocab, 8).collect()}
    assert all(len(r.input_ids) == 8 and len(r.attention_mask) == 8 for r in enc.values())
    assert enc[3].n_tokens == 0 and enc[4].n_tokens == 0 and enc[5].n_tokens == 8
    assert enc[1].attention_mask == [1, 1, 1, 0, 0, 0, 0, 0]
    assert enc[1].input_ids[:2] == enc[2].input_ids[:2]


def test_metrics_properties(spark):
    rows = [(0, 0), (0, 1), (1, 1), (1, 1), (2, 0), (2, 2), (2, 2)]
    df = spark.createDataFrame(rows, "label int, pred int")
    acc = M.accuracy(df).collect()[0].accuracy
    w = M.weighted_prf(df).collect()[0]
    assert abs(w.recall - acc) < 1e-12  # weighted recall = accuracy
    none = spark.createDataFrame([(1, 0), (1, 0)], "label int, pred int")
    b = M.binary_prf(none).collect()[0]
    assert b.precision == 0.0 and b.recall == 0.0 and b.f1 == 0.0
    m = M.metrics(df, 3).collect()[0]
    assert m.average == "weighted" and m.accuracy == round(5 / 7, 4)
    assert M.metrics(df, 3, mode="accuracy").collect()[0].accuracy == round(5 / 7, 4)
    for name in M.METRIC_FUNCTIONS:
        assert len(M.compute_metric(df, name).collect()) == 1
    with pytest.raises(ValueError):
        M.compute_metric(df, "nothing")


def test_softmax_sums_to_one_and_smoothing(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], 1)], "l array<double>, y int")
    r = df.select(softmax(F.col("l")).alias("p"), label_smoothing(F.col("y"), 3, 0.1).alias("s")).collect()[0]
    assert abs(sum(r.p) - 1) < 1e-12 and abs(sum(r.s) - 1) < 1e-12 and abs(r.s[1] - (0.9 + 0.1 / 3)) < 1e-12


def test_layer_group_key_on_parameter_names(spark):
    from corpusflow.operators.profile import layer_group_key, path_group_mean
    rows = [("distilbert.transformer.layer.0.attention.q_lin.weight", 0.2),
            ("distilbert.transformer.layer.0.attention.v_lin.weight", 0.4),
            ("distilbert.transformer.layer.3.ffn.lin1.weight", 1.0),
            ("classifier.weight", 9.0), ("enc.7", 5.0)]
    df = spark.createDataFrame(rows, "name string, score double")
    keys = [r.k for r in df.select(layer_group_key(F.col("name")).alias("k")).collect()]
    assert keys == ["layer_0_attention", "layer_0_attention", "layer_3_ffn", None, "layer_7"]
    g = {r.group_key: (r.mean_score, r.n_items) for r in path_group_mean(df, "name", "score").collect()}
    assert g == {"layer_0_attention": (0.30000000000000004, 2), "layer_3_ffn": (1.0, 1), "layer_7": (5.0, 1)}


def test_mean_std_rows(spark):
    from corpusflow.operators.analytics import mean_std_rows
    df = spark.createDataFrame([("lora", 90.06, 91.0), ("lora", 91.51, 91.7), ("ADAPTER", 88.0, 87.25)],
                               "method string, accuracy double, f1 double")
    rows = {r.method: r.row for r in mean_std_rows(df, ["accuracy", "f1"]).collect()}
    # capitalised name, "mean \\pm std" with one decimal, std omitted for a single run;
    # one decimal = round half-up on the shortest decimal form (91.35 -> 91.4)
    assert rows["lora"] == "Lora & $90.8 \\pm 1.0$ & $91.4 \\pm 0.5$ \\\\"
    assert rows["ADAPTER"] == "Adapter & $88.0$ & $87.3$ \\\\"


def test_median_int_equals_percentile(spark):
    import random
    from corpusflow.operators.profile import median_int
    rnd = random.Random(2)
    rows = [(g, rnd.choice([None] + list(range(50)))) for g in range(9) for _ in range(rnd.randint(1, 40))]
    rows += [(99, None), (99, None), (100, 7)]  # an all-null group and a one-row group
    df = spark.createDataFrame(rows, "g int, v int")
    a = {r.g: r.median_int for r in median_int(df, "g", "v").collect()}
    b = {r.g: r.m for r in df.groupBy("g").agg(F.percentile("v", 0.5).cast("int").alias("m")).collect()}
    assert a == b and a[99] is None and a[100] == 7


def test_html_unescape_follows_the_standard_library(spark):
    import html
    from corpusflow.functions.text import html_unescape
    some = ["caf&eacute; &#8217; &amp;#38; &amp;amp; &lt;b&gt;", "&notit; &notin; &ampx &am &copy2 &;& &#; &#x;", "&#0; &#128; &#x9f; &#x81; &#55296; &#x110000; &#99999999999;",
            "&#1; &#11; &#13; &#x7f; &#xfdd0; &#x1ffff; &#x1F600; &#0065;", "&NotEqualTilde; &fjlig; &nbsp &quotx;&quot", "", "plain", "a & b && c &", None,
            "&" + "x" * 40 + "; &ngE; &unknownname; &LT&GT", "&#000000000000065; &#x0000000000041 &Aacute"]
    df = spark.createDataFrame(list(enumerate(some)), "i int, t string")
    got = [r.o for r in df.select("i", html_unescape(F.col("t")).alias("o")).orderBy("i").collect()]
    assert got == [None if t is None else html.unescape(t) for t in some]


def test_t_distribution_against_known_values(spark):
    from corpusflow.operators.analytics import t_critical, t_p_value
    rows = [(1, 12.706), (2, 4.303), (5, 2.571), (30, 2.042), (40, 2.021), (60, 2.000), (121, 1.980), (400, 1.966)]
    got = spark.createDataFrame(rows, "df int, t double").select(
        "df", "t", t_critical(F.col("df")).alias("c"), t_p_value(F.col("t"), F.col("df")).alias("p")).collect()
    for r in got:
        assert abs(r.c - r.t) < 0.0011 and abs(r.p - 0.05) < 2e-4, r


def test_replacement_looks_through_case_and_marks(spark):
    from corpusflow.operators.noise import replace_from_cache
    df = spark.createDataFrame([(1, "Big dogs, (big) DOGS! bigger"), (2, ""), (3, None)], "k int, text string")
    cache = spark.createDataFrame([("big", "large"), ("dogs", "hounds")], "term string, replacement string")
    got = {r.k: r.text_out for r in replace_from_cache(df, "text", "k", cache, 1.1, 1).collect()}
    assert got == {1: "large hounds, (large) hounds! bigger", 2: "", 3: ""}
