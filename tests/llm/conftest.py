import pytest
from pyspark.sql import functions as F

#: Names that the operators use inside or give to their results.
CLASHING = ["row", "_row", "_text", "_id", "_d1", "_d2", "_h", "_b", "size", "taken", "fp", "component_id", "_n", "score", "_out", "_line", "_gone"]


def clash(df):
    return df.withColumns({c: F.lit("x") for c in CLASHING})


@pytest.fixture(scope="module", autouse=True)
def uncached(spark):
    """Tables that a module's tests cache are not left to tests that look at plans of the same files."""
    yield
    spark.catalog.clearCache()


@pytest.fixture(scope="session")
def messy(spark):
    """Documents with nulls in every column, empty, blank and very long texts, ties and repeated rows."""
    line = "this line of boilerplate stands on many sites"
    long = " ".join(f"w{i % 9973}x{i}" for i in range(30_000))
    rows = [(1, None, "en", "a", 0), (2, "", "en", "b", 0), (3, " \n\t ", None, None, 5), (None, "text without an id", "de", "c", 18),
            (4, long, "en", "a", len(long)), (5, "twice the same", "fr", "b", 14), (5, "twice the same", "fr", "b", 14),
            (6, "twice the same", None, "c", None), (None, None, None, None, None), (7, "日本語 の テキスト é ▁ x\x00y", "xx", "d", 20),
            (8, "12 345 !!", "en", None, 9), (9, "a\n\nb\n" + line, "en", "e", 50)]
    rows += [(100 + i, f"own words number {i} here\n{line}\nend {i} of the text", "en", f"s{i % 12}", 70) for i in range(24)]
    return clash(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).cache()


@pytest.fixture(scope="session")
def empty(messy):
    return messy.limit(0)
