"""Language identification by nearest centroid.

A text is a vector over hashed byte trigrams of its lower-cased letters (words
apart by single spaces): sublinear counts times inverse document frequency,
scaled to length one.  Document frequencies are counted over all training rows.
Each language has several centroids, clustered by cosine from a bounded sample
of its training rows (``PER_LANGUAGE`` rows, those with the smallest hash), so
that its kinds of text get one each.  The nearest centroid by cosine names the
language; a text that lies farther from it than nearly all of the sample did is
rejected.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm.arrow import arrow_udf, on_workers, parts, struct
from corpusflow.llm.common import cut, held_out

#: log2 of the vector's width, training rows per language that centroids come from, centroids per language.
WIDTH_BITS, PER_LANGUAGE, CENTROIDS = 14, 400, 3
#: A text is rejected below this share of the sample's lowest ordinary cosine (its first percentile).
REJECT = 0.5
#: Numerals that count as word characters without being letters or decimal digits, as one half or Roman eight.
NUMERALS = {c: " " for c in map(chr, range(sys.maxunicode + 1)) if c.isnumeric() and not c.isalpha() and not c.isdecimal()}
BLANKED = str.maketrans(NUMERALS)
NO_LETTER = re.compile(r"[\W\d_]+")
#: Rows of a language are first ranked within this many hash buckets.
BUCKETS = 64
UNKNOWN = "und"


def counts(text: str) -> np.ndarray | None:
    """Trigram counts of a text, None without letters."""
    text = text.lower()
    if not text.isascii() and not NUMERALS.keys().isdisjoint(text):
        text = text.translate(BLANKED)
    words = NO_LETTER.sub(" ", text).strip()
    if not words:
        return None
    b = np.frombuffer(f" {words} ".encode("utf-8"), dtype=np.uint8).astype(np.uint32)
    grams = b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)
    slots = (grams * np.uint32(2654435761)) >> np.uint32(32 - WIDTH_BITS)
    return np.bincount(slots, minlength=1 << WIDTH_BITS)


def vectors(texts: list[str], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the texts with letters, and which texts those are."""
    out = np.zeros((len(texts), 1 << WIDTH_BITS), dtype=np.float32)
    there = np.zeros(len(texts), dtype=bool)
    for i, t in enumerate(texts):
        c = counts(t)
        if c is not None:
            used = np.flatnonzero(c)
            v = np.log1p(c[used]) * idf[used]
            out[i, used] = v / max(np.sqrt(v @ v), 1e-12)
            there[i] = True
    return out, there


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids by spherical k-means from farthest-first seeds; the rows' order decides ties."""
    mean = x.mean(axis=0)
    seeds = [int((x @ mean).argmax())]
    near = x @ x[seeds[0]]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(near.argmin()))
        near = np.maximum(near, x @ x[seeds[-1]])
    c = x[seeds]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        c = np.stack([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


@dataclass
class Model:
    """Languages of the centroids, the centroids, their lowest ordinary cosines, and the weights."""

    languages: list[str]
    centroids: np.ndarray
    floor: np.ndarray
    idf: np.ndarray


def document_frequencies(rows: DataFrame, text: str) -> np.ndarray:
    """Share of all rows with letters that hold each trigram slot, counted by Spark."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((1 << WIDTH_BITS) + 1, dtype=np.int64)
        for batch in batches:
            for some in parts(batch.column(0)):
                for t in some:
                    c = counts(t)
                    if c is not None:
                        seen[:-1] += c > 0
                        seen[-1] += 1
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(seen[used])], names=["slot", "n"])

    sums = rows.select(text).mapInArrow(tally, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    out = np.zeros((1 << WIDTH_BITS) + 1)
    for r in sums.collect():  # at most 2**WIDTH_BITS + 1 rows
        out[r["slot"]] = r["n"]
    return out


def fit(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
        per_language: int = PER_LANGUAGE, centroids: int = CENTROIDS) -> Model:
    """Learn from the rows outside the evaluation fold whose ``lang`` and ``text`` are not null.

    Rows without letters teach nothing.  Without any usable row the model has
    no languages and predicts ``und`` throughout.
    """
    on_workers()
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"), F.col(lang).cast("string").alias("_lang")).where(
        ~held_out(doc_id) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    seen = document_frequencies(rows, "_text")
    idf = (np.log((1 + seen[-1]) / (1 + seen[:-1])) + 1).astype(np.float32)
    order = (F.xxhash64(F.lit(17), "_id"), "_id", "_h")
    lettered = rows.where(F.col("_text").rlike(r"\p{L}")).withColumn("_h", F.xxhash64("_text"))
    # ranked on ids and digests alone, first within buckets, so that no task meets all rows of a language;
    # the few chosen rows then fetch their texts
    chosen = lettered.select("_id", "_lang", "_h", F.pmod(F.xxhash64(F.lit(23), "_id", "_h"), F.lit(BUCKETS)).alias("_b"))
    for keys in (["_lang", "_b"], ["_lang"]):
        chosen = chosen.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= per_language)
    key = ["_id", "_lang", "_h"]
    # per_language rows for each language; repeated rows count once
    sample = lettered.join(F.broadcast(cut(chosen.select(key).distinct())), key).dropDuplicates(key)

    def centres(batch: pa.Table) -> pa.Table:
        texts = sorted(batch["_text"].to_pylist())
        x, there = vectors(texts, idf)
        x = x[there]
        if not len(x):
            return pa.table({"lang": pa.array([], pa.string()), "centroid": pa.array([], pa.binary()), "floor": pa.array([], pa.float64())})
        c = cluster(x, centroids)
        near = x @ c.T
        own = near.argmax(axis=1)
        floor = [float(np.quantile(near[own == j, j], 0.01)) if (own == j).any() else 0.0 for j in range(len(c))]
        return pa.table({"lang": [batch["_lang"][0].as_py()] * len(c), "centroid": [v.astype("<f4").tobytes() for v in c], "floor": floor})

    found = sample.groupBy("_lang").applyInArrow(centres, "lang string, centroid binary, floor double").collect()
    found.sort(key=lambda r: (r["lang"], r["centroid"]))  # a few centroids for each language
    width = 1 << WIDTH_BITS
    return Model([r["lang"] for r in found],
                 np.array([np.frombuffer(r["centroid"], "<f4") for r in found], dtype=np.float32).reshape(-1, width),
                 np.array([r["floor"] for r in found]), idf)


def identify(text: Column, model: Model, reject: bool = True) -> Column:
    """Struct of ``lang_pred``, ``score`` (cosine of the nearest centroid, 0 to 1) and ``rejected``.

    Null texts and texts without a letter are ``und`` with score 0.  A rejected
    text is ``und`` too, unless ``reject`` is off: then only the flag tells.
    """

    @arrow_udf("struct<lang_pred: string, score: double, rejected: boolean>")
    def of(texts: pa.Array) -> pa.Array:
        langs, scores, far = [], [], []
        for some in parts(texts, 1 << 18):
            x, there = vectors(some, model.idf)
            there &= len(model.languages) > 0
            near = x @ model.centroids.T if len(model.languages) else np.zeros((len(some), 1))
            best = near.argmax(axis=1)
            cos = np.clip(near[np.arange(len(some)), best], 0, 1)
            for i in range(len(some)):
                out = bool(there[i]) and cos[i] < REJECT * model.floor[best[i]]
                langs.append(model.languages[best[i]] if there[i] and not (out and reject) else UNKNOWN)
                scores.append(float(cos[i]) if there[i] else 0.0)
                far.append(out)
        return struct({"lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64()), "rejected": pa.array(far, pa.bool_())})

    return of(text)
