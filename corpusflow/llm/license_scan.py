"""Licence scans by a trained paragraph classifier over word n-grams.

A paragraph is a run of lines between blank lines; where its lines break says
nothing.  Every two-gram of a paragraph that tells of a template opens windows
of a few sizes, from about the shortest notice to the longest, so that a notice
is seen whole and by itself however it is wrapped and whatever stands around
it.  A multinomial logistic regression over sparse word one- and two-grams
tells licence families and an unknown class apart.  It is trained on the
notices in ``TEMPLATES`` (whole and in halves) and, for the unknown class, on a
bounded sample of the corpus's own windows (``UNKNOWN_SAMPLE``, those with the
smallest hash).  Windows of paragraphs that come near a template teach nothing.
All other windows of the corpus that do not teach calibrate the probability
that each family needs.  A prediction stands only if the window holds most of
the two-grams of one of the family's templates.

A passage without any telling two-gram of a template could never be confirmed,
so only windows are scored, each distinct set of n-grams once.  Only DataFrame
functions are used (the DataFrame API of ``pyspark.ml`` for the regression).
"""

from __future__ import annotations

import re

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import cut, row_digest, text_or_empty

#: Notices by family, as they are worded in public.
TEMPLATES = {
    "agpl": ["licensed under the GNU Affero General Public License",
             "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "apache": ["Licensed under the Apache License, Version 2.0",
               "you may not use this file except in compliance with the License",
               "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS"],
    "bsd": ["Released under the BSD License",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "cc-by": ["Licensed under CC BY 4.0",
              "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0",
                 "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-nd": ["Licensed under CC BY-ND 4.0",
                 "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0",
                 "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc0": ["dedicated to the public domain under CC0 1.0 Universal",
            "waived all copyright and related or neighboring rights to this work"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3",
            "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "lgpl": ["licensed under the GNU Lesser General Public License",
             "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "mit": ["Released under the MIT License",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License"],
    "proprietary": ["All rights reserved",
                    "may not be reproduced or distributed without the prior written permission of the publisher"],
}
#: Words too common to tell anything in pairs with one another.
COMMON = frozenset("a all an and any are as at be by for from in is it may not of on or that the this to was with without you".split())
UNKNOWN_SAMPLE, CONFIRM, FALSE_ALARMS = 4000, 0.6, 0.001
#: A paragraph that holds this share of a template's two-grams is no example of the unknown class.
NEAR = 0.3
#: Between paragraphs: lines without anything but white space.
BLANK_LINES = r"\n[\x09-\x0D\x20]*\n"


def template_words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def two_grams(words: list[str]) -> list[str]:
    return [f"{a} {b}" for a, b in zip(words, words[1:])]


def telling() -> list[str]:
    """Two-grams of the templates with at least one uncommon word.

    Each template keeps more than ``1 - CONFIRM`` of its two-grams here, so a
    paragraph that lacks them all cannot reach ``CONFIRM`` of any template.
    """
    out: set[str] = set()
    for texts in TEMPLATES.values():
        for t in texts:
            grams = set(two_grams(template_words(t)))
            own = {g for g in grams if not set(g.split()) <= COMMON}
            if len(own) <= (1 - CONFIRM) * len(grams):
                own = grams
            out |= own
    return sorted(out)


def vocabulary() -> list[str]:
    words = [template_words(t) for texts in TEMPLATES.values() for t in texts]
    return sorted({g for w in words for g in [*w, *two_grams(w)]})


def reach() -> tuple[int, list[int]]:
    """Words a window takes before its telling two-gram, and the words of windows from there on.

    A template's first telling two-gram has at most the former before it and, with the largest
    window, all of the template after it.
    """
    gate, words = set(telling()), [template_words(t) for texts in TEMPLATES.values() for t in texts]
    lead = max(next(i for i, g in enumerate(two_grams(w)) if g in gate) for w in words)
    longest = max(map(len, words))
    return lead, sorted({-(-longest // 4), -(-longest // 2), longest})


def paragraph_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def paragraph_pairs(words: Column) -> Column:
    n = F.size(words) - 1
    pairs = F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(n >= 1, pairs).otherwise(F.array().cast("array<string>"))


def windows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``_d1``, ``_d2`` (the row's digest), ``_para`` (from 0), ``_near`` (whether the paragraph comes near a template)
    and ``_grams``, the template n-grams of one window: a row for every telling two-gram and size of window."""
    gate, vocab, (lead, sizes) = telling(), vocabulary(), reach()
    known = sorted({g for texts in TEMPLATES.values() for t in texts for g in two_grams(template_words(t))})
    runs = docs.select(*row_digest(doc_id, text), F.posexplode(F.split(text_or_empty(text), BLANK_LINES, -1)).alias("_para", "_run"))
    words = runs.select("_d1", "_d2", "_para", paragraph_words(F.col("_run")).alias("_words"))
    pairs = words.withColumn("_two", paragraph_pairs(F.col("_words")))
    hits = pairs.withColumn("_hits", F.filter(F.transform("_two", lambda g, i: F.when(g.isin(gate), i)), lambda i: i.isNotNull()))
    own = F.array_distinct(F.filter("_two", lambda g: g.isin(known)))
    near = F.when(F.size("_hits") > 0, F.array_max(coverage(own, sorted(TEMPLATES))) >= NEAR)

    def opened(size: int) -> Column:
        return F.transform("_hits", lambda i: F.slice(F.col("_words"), F.greatest(i - lead, F.lit(0)) + 1, F.least(i, F.lit(lead)) + size))

    some = F.concat(*map(opened, sizes))
    # the outer form, so that Spark does not make all of this once more for a filter on the array's size
    cut_out = hits.select("_d1", "_d2", "_para", near.alias("_near"), some.alias("_some")).select(
        "_d1", "_d2", "_para", "_near", F.explode_outer("_some").alias("_words")).where(F.col("_words").isNotNull())
    two = cut_out.withColumn("_two", paragraph_pairs(F.col("_words")))
    return two.select("_d1", "_d2", "_para", "_near", F.array_sort(F.array_distinct(
        F.filter(F.concat("_words", "_two"), lambda g: g.isin(vocab)))).alias("_grams"))


def coverage(grams: Column, families: list[str]) -> Column:
    """For each family the best share of a template's two-grams that a paragraph holds."""
    out = []
    for f in families:
        shares = []
        for t in TEMPLATES[f]:
            two = sorted(set(two_grams(template_words(t))))
            shares.append(F.size(F.array_intersect(grams, F.array(*[F.lit(g) for g in two]))) / F.lit(len(two)))
        out.append(F.greatest(*shares) if len(shares) > 1 else shares[0])
    return F.array(*out)


def scan_licenses(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``id``, ``license`` (most probable family found, null if none), ``families``
    (all found, sorted and joined by ``|``, empty if none), ``n_license`` (families found, summed over the
    paragraphs), ``n_unconfirmed`` (paragraphs where a family is predicted, but all are unlike their templates)
    and ``score`` (largest probability of a family found, 0 if none).

    Null and empty texts have nothing.  Rows with equal id and text get equal
    results; null ids are kept.  Ties in probability go to the first family by
    name.  Other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    families = sorted(TEMPLATES)
    seen = cut(windows(docs, doc_id, text).withColumns({"_h1": F.xxhash64("_grams"), "_h2": F.hash("_grams")})
               .dropDuplicates(["_d1", "_d2", "_para", "_h1", "_h2"]))
    distinct = cut(seen.groupBy("_h1", "_h2").agg(F.any_value("_grams").alias("_grams"), F.max("_near").alias("_near")))

    notices = [(float(families.index(f) + 1), template_words(t)) for f in families for t in TEMPLATES[f]]
    examples = [(c, sorted({*part, *two_grams(part)})) for c, w in notices
                for part in (w, w, w[:len(w) // 2 + 1], w[len(w) // 2:])]
    order = [F.xxhash64(F.lit(29), "_h1", "_h2"), F.col("_h1"), F.col("_h2")]
    taught = cut(distinct.where(~F.col("_near")).orderBy(*order).limit(UNKNOWN_SAMPLE).select("_h1", "_h2", "_grams"))
    n = taught.count()
    teach = spark.createDataFrame(examples, "label double, _grams array<string>").withColumn("weight", F.lit(1.0))
    teach = teach.unionByName(taught.select(F.lit(0.0).alias("label"), "_grams", F.lit(2 * len(examples) / max(1, n)).alias("weight")))
    # without unknown windows an empty paragraph stands for them
    teach = teach.unionByName(spark.createDataFrame([(0.0, [], 1.0)], "label double, _grams array<string>, weight double"))
    vectors = CountVectorizerModel.from_vocabulary(vocabulary(), inputCol="_grams", outputCol="features", minTF=0.0)
    model = LogisticRegression(weightCol="weight", regParam=1e-3, maxIter=100, standardization=False, family="multinomial").fit(
        vectors.transform(teach.coalesce(1)))  # a few thousand rows: one task for each step of the fit

    known = F.slice("_p", 2, len(families))
    judged = model.transform(vectors.transform(distinct)).withColumn("_p", vector_to_array("probability")).select(
        "_h1", "_h2", "_near", F.array_max(known).alias("prob"), F.array_position(known, F.array_max(known)).cast("int").alias("_family"),
        F.element_at(coverage(F.col("_grams"), families), F.array_position(known, F.array_max(known)).cast("int")).alias("_held"))
    judged = cut(judged)
    # the probability a family needs: what but few of the corpus's other windows reach, over all that taught nothing
    others = judged.where(~F.col("_near")).join(taught.select("_h1", "_h2"), ["_h1", "_h2"], "left_anti")
    alarms = {r["_family"]: r["p"] for r in others.groupBy("_family").agg(
        F.percentile_approx("prob", F.lit(1 - FALSE_ALARMS), F.lit(100_000)).alias("p")).collect()}  # a row a family
    needed = F.element_at(F.array(*[F.lit(max(0.5, alarms.get(k + 1) or 0.0)) for k in range(len(families))]), F.col("_family"))
    name = F.element_at(F.array(*[F.lit(f) for f in families]), F.col("_family"))
    found = judged.where(F.col("prob") > needed).select("_h1", "_h2", (F.col("_held") >= CONFIRM).alias("_sure"), name.alias("family"), "prob")
    sure = F.col("_sure")
    top = F.struct((-F.col("prob")).alias("p"), F.col("family").alias("f"))
    per_paragraph = seen.select("_d1", "_d2", "_para", "_h1", "_h2").join(found, ["_h1", "_h2"]).groupBy("_d1", "_d2", "_para").agg(
        F.collect_set(F.when(sure, F.col("family"))).alias("_all"), F.min(F.when(sure, top)).alias("_top"))
    per_doc = per_paragraph.groupBy("_d1", "_d2").agg(
        F.sum(F.size("_all")).alias("n_license"), F.count(F.when(F.size("_all") == 0, 1)).alias("n_unconfirmed"),
        F.min("_top").alias("_top"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("_all")))).alias("_all"))
    rows = docs.select(F.col(doc_id).alias("id"), *row_digest(doc_id, text)).join(per_doc, ["_d1", "_d2"], "left")
    zero = F.lit(0).cast("bigint")
    return rows.select("id", F.col("_top.f").alias("license"), F.coalesce(F.array_join("_all", "|"), F.lit("")).alias("families"),
                       F.coalesce("n_license", zero).alias("n_license"), F.coalesce("n_unconfirmed", zero).alias("n_unconfirmed"),
                       F.coalesce(-F.col("_top.p"), F.lit(0.0)).alias("score"))
