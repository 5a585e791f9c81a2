"""Tokenising, rules, classifiers and scans against the libraries, plain Python and held-out labels."""

import collections
import random
import re
import textwrap
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.dataset as ds
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from corpusflow.llm import language, quality_cnn
from corpusflow.llm.common import row_digest
from corpusflow.llm.license_scan import CONFIRM, TEMPLATES, coverage, reach, scan_licenses, telling, template_words, two_grams, vocabulary, windows
from corpusflow.llm.q_quality_cnn import KEEP
from corpusflow.llm.quality_rules import COVERAGE, LINES, measures, repetition_rules
from corpusflow.llm.sentencepiece_bpe import Encoder, encode_decode, split_stretches
from corpusflow.llm.token_output import Sequences, place, read_documents, write_sequences
from corpusflow.llm.unit_encoder import UnitEncoder

SF01 = "/root/testdata/sf0.01"
PIECES, BYTES = (public_tokenizers.path(n) for n in ("piece_bpe_32k.model", "byte_bpe_50k.json"))
WORD = re.compile(r"[^\x20\x09-\x0D]+")

random.seed(4)
ODD = ["", " ", "  ", " a", "a ", "  a  b  ", "▁x▁▁y", "\n\n a\n", "日本語 テキスト", "a" * 300 + " " + "ab" * 400, "\t\r\x00x", "😀 é ﬁ", "a▁",
       "<s> </s> <unk> <0x41>", "it's we're 's x'll, don't.", "<|endoftext|> x <|endoftext|>", "a. b... c!!?? 1,2 3. x\n y \n z"]
ODD += ["".join(random.choice("ab \n▁é日!1.,'sT") for _ in range(random.randint(0, 60))) for _ in range(1500)]


def texts(n=200):
    return ds.dataset(f"{SF01}/documents.parquet").to_table(columns=["text"])["text"].to_pylist()[:n]


def test_agenda_equals_the_library():
    e = Encoder(PIECES)
    library = e.vocabulary.library
    for some in (ODD, texts()):
        own = [np.frombuffer(b, "<u4").tolist() for b in e.encode(some)]
        assert own == library.encode(some)
        assert [library.decode(x) for x in own] == [t.replace("▁", " ") for t in some]
        assert [e.vocabulary.decode(x)[1:] for x in own] == [t.replace("▁", " ") for t in some]


def test_rows_and_heap_run_the_same_agenda():
    v = Encoder(PIECES).vocabulary
    words = sorted({"▁" + w for t in texts(40) + ODD for w in split_stretches(t)})
    rows = [np.frombuffer(b, "<u4").tolist() for b in v.agenda(words)]
    assert rows == [v.by_heap(w) for w in words]


def test_stores_may_be_emptied(monkeypatch):
    from corpusflow.llm import sentencepiece_bpe, unit_encoder
    monkeypatch.setattr(sentencepiece_bpe, "KEPT", 64)
    monkeypatch.setattr(unit_encoder, "KEPT", 64)
    a, b = Encoder(PIECES), UnitEncoder(BYTES, spaced=True)
    whole = tokenizers.Tokenizer.from_file(BYTES)
    for t in texts(30):
        assert np.frombuffer(a.encode([t])[0], "<u4").tolist() == a.vocabulary.library.encode(t)
        assert b.encode(pa.array([t]))[0].tolist() == whole.encode(t, add_special_tokens=False).ids


def test_sentencepiece_of_messy_rows(messy, empty):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    out = encode_decode(F.col("text"), PIECES, digests=False)
    for r in messy.select("text", out.alias("o")).collect():
        ids = [1, *sp.encode(r["text"] or ""), 2]
        assert np.frombuffer(r["o"]["ids"], "<u4").tolist() == ids and r["o"]["n_tokens"] == len(ids)
        assert r["o"]["decoded"] == sp.decode(ids)
    assert empty.select(out.alias("o")).count() == 0


#: Neighbours of every class of bytes: white space of all kinds, marks that compose, special tokens, contractions.
UNITS = ["x <|ENDOFTEXT|> <|StartOfText|> <|startoftext|>a", "<|endoftext|>", "a<|endoftext|>\n\n <|endoftext|> b", "a<|b <| |> c|", "İ! İs ÉÀ é! Ω Σς ΑΣ. 12½ Ⅷ²",
         "a\u00a0b \u3000c \u2003 ", "a b\u200bc\x0bd \x0b e\x1cf", "×÷ a×b", None]
UNITS += ["".join(random.choice(letters) for _ in range(random.randint(0, 60)))
          for letters in ("ab \n\u00a0▁é日!1.,'sTÀ\u0301 |<ǅ×", "ab \n\t\r!1.,'sTÉ×", "a \u3000.\u2028\x85\v") for _ in range(1500)]


@pytest.mark.parametrize("name, spaced, plain", [("byte_bpe_50k.json", True, False), ("byte_bpe_50k.json", True, True), ("word_bpe_49k.json", False, False)])
def test_units_equal_the_whole_tokenizer(name, spaced, plain):
    path = public_tokenizers.path(name)
    e, whole = UnitEncoder(path, spaced, encode_special_tokens=plain), tokenizers.Tokenizer.from_file(path)
    whole.encode_special_tokens = plain
    some = ODD + UNITS + texts()
    for k in range(0, len(some), 50):
        ids, n = e.encode(pa.array(some[k:k + 50], pa.string()))
        got = [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
        assert got == [whole.encode(t or "", add_special_tokens=False).ids for t in some[k:k + 50]]


def test_sequences_read_back(spark, messy):
    whole = tokenizers.Tokenizer.from_file(BYTES)
    special = spark.createDataFrame([(50, "x <|endoftext|> y"), (51, "<|endoftext|>")], "doc_id long, text string")
    messy = messy.unionByName(special, allowMissingColumns=True)
    docs = messy.repartition(3)
    manifest = write_sequences(docs, BYTES, end_id=2, length=64, rows_per_batch=4)
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in read_documents(manifest, max_rows=5).collect()))
    rows = [(r["doc_id"], whole.encode(r["text"] or "", add_special_tokens=False).ids + [2]) for r in messy.collect()]
    crc = sorted((i is not None, i or 0, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in rows)
    assert crc == sorted((i is not None, i or 0, n, c) for _, i, n, c in got)
    assert [g[0] for g in got] == np.concatenate(([0], np.cumsum([g[2] for g in got])[:-1])).tolist()
    ids = [g[1] for g in got]
    assert [i for i in ids if i is not None] == sorted(i for i in ids if i is not None) and ids[:2] == [None, None]
    for f in manifest.collect():
        s = Sequences(f["ids_path"])
        assert len(s) == -(-f["n_tokens"] // 64)
        used = sum(np.asarray(s.sequence(i)[1]).sum() for i in range(len(s)))
        assert used == f["n_tokens"] and all(len(s.sequence(i)[0]) == 64 for i in range(len(s)))
        mapped = pa.memory_map(place(f["ids_path"])[1])
        assert pa.total_allocated_bytes() >= 0 and pa.ipc.open_stream(mapped).schema.field("ids").type.list_size == 64


def test_sequences_of_no_rows(empty):
    manifest = write_sequences(empty, BYTES, end_id=2)
    assert manifest.count() == 0 and read_documents(manifest).count() == 0


def brute_rules(text):
    w = WORD.findall(text)
    windows = collections.Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    inside = {i + k for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for k in range(3)}
    seen, dup, dup_chars = set(), 0, 0
    for line in text.split("\n"):
        if WORD.search(line):
            if line in seen:
                dup, dup_chars = dup + 1, dup_chars + sum(map(len, WORD.findall(line)))
            seen.add(line)
    out = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
           "n_dup_lines": dup, "n_repeat_words": len(inside), "dup_line_chars": dup_chars}
    for n in COVERAGE:
        times = collections.Counter(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
        again = {i + k for i in range(len(w) - n + 1) if times[tuple(w[i:i + n])] > 1 for k in range(n)}
        out[f"repeat_chars_{n}"] = sum(len(w[i]) for i in again)
    return out


def brute_kept(text):
    """The verdict by the rules' wording: base rule, coverage by n-gram length, repeated lines, one framing line excused."""
    m = brute_rules(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    frame = WORD.findall(lines[0]) if len(lines) > 2 and lines[0] == lines[-1] and lines.count(lines[0]) == 2 else []
    excused = sum(map(len, frame))
    if m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"]:
        return False
    return m["dup_line_chars"] - excused <= LINES * m["word_chars"] and all(
        m[f"repeat_chars_{n}"] - 2 * excused * (len(frame) >= n) <= COVERAGE[n] * m["word_chars"] for n in COVERAGE)


def test_repetition_verdict_over_the_corpus(spark):
    from corpusflow.llm.queries import QUERIES
    got = {r["doc_id"]: r["kept"] for r in QUERIES["op9_repetition_rules"](spark, SF01).collect()}
    docs = ds.dataset(f"{SF01}/documents.parquet").to_table(columns=["doc_id", "text"]).to_pylist()
    assert got == {d["doc_id"]: brute_kept(d["text"] or "") for d in docs}


def test_repetition_verdict_drops_planted_repeats_and_leaves_clean_texts(spark):
    """A passage that stands twice and fills 20 to 60 % of the characters, apart or in pieces."""
    rng, rows = random.Random(9), []
    for i in range(200):
        own = [f"w{rng.randrange(10 ** 6):06}" for _ in range(rng.randint(80, 600))]
        rows.append((2 * i, " ".join(own)))
        twice = int(len(own) * rng.uniform(0.25, 1.2) / 2)
        copy, at = own[:twice], rng.randint(twice, len(own))
        rows.append((2 * i + 1, " ".join(own[:at] + copy + own[at:])))
    df = spark.createDataFrame(rows, "i long, text string").select("i", repetition_rules(F.col("text")).alias("o"))
    kept = {r["i"]: r["o"]["kept"] for r in df.collect()}
    assert all(kept[2 * i] for i in range(200)) and not any(kept[2 * i + 1] for i in range(200))


def test_repetition_measures_equal_plain_counting():
    some = [*ODD[:300], *texts(150), "one two three four five six " * 40, "é é é\n é é é\n"]
    got = measures(some, sorted(COVERAGE))
    for i, t in enumerate(some):
        want = brute_rules(t)
        assert {k: int(v[i]) for k, v in got.items()} == want, t[:80]


def test_repetition_rules_of_messy_rows(spark, messy, empty):
    for r in messy.select("text", repetition_rules(F.col("text")).alias("o")).collect():
        want, o = brute_rules(r["text"] or ""), r["o"]
        assert {k: o[k] for k in want} == want
        assert o["base_failed"] == (want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"])
        assert not (o["kept"] and o["base_failed"])
    assert empty.select(repetition_rules(F.col("text"))).count() == 0
    block = " ".join(f"word{i}" for i in range(60))
    own = " ".join(f"other{i}" for i in range(60))
    rows = spark.createDataFrame([(1, own), (2, f"{block}\n{own}\n{block}\nx y"), (3, f"{block} z {block} {block} {own}")], "i long, text string")
    got = {r["i"]: r["o"] for r in rows.select("i", repetition_rules(F.col("text")).alias("o")).collect()}
    assert got[1]["kept"] and not got[2]["kept"] and not got[3]["kept"]


def test_repetition_limits_between_a_tenth_and_a_third(spark):
    own = [f"word{i:03}" for i in range(100)]
    copies = {n: " ".join([*own, *own[:n]]) for n in (6, 8, 15, 25, 40)}  # 11, 15, 26, 40 and 57 % in all copies
    line = " ".join(f"head{i:03}" for i in range(12))
    body = " ".join(own[:40])
    rows = [*copies.items(), (1, f"{line}\n{body}\n{line}"), (2, f"{line}\n{body}\n{line}\n{body[:80]}\n{line}"),
            (3, f"{body}\n{line}\n{line}\nend of it")]
    df = spark.createDataFrame(rows, "i long, text string")
    kept = {r["i"]: r["o"]["kept"] for r in df.select("i", repetition_rules(F.col("text")).alias("o")).collect()}
    assert kept == {6: True, 8: False, 15: False, 25: False, 40: False, 1: True, 2: False, 3: False}


def test_quality_network_on_held_out_rows(spark):
    from corpusflow.llm.queries import QUERIES
    got = QUERIES["op6_quality_network"](spark, SF01).collect()
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= KEEP) for r in got)
    checked = [(label[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in label]
    assert len(checked) > 50 and np.mean([a == b for a, b in checked]) >= 0.93


def test_quality_scores_do_not_depend_on_neighbours():
    rng = np.random.default_rng(1)
    shape = (quality_cnn.WIDTH, quality_cnn.SYMBOLS, quality_cnn.FILTERS)
    net = quality_cnn.Network(rng.normal(size=shape).astype(np.float32), np.zeros(quality_cnn.FILTERS, np.float32), rng.normal(size=32), 0.1)
    some = [*ODD[:60], *texts(20), "\x00" * 50, "x" * 257]
    assert np.allclose(net.score(some), [net.score([t])[0] for t in some])
    rows, first = quality_cnn.chunks(["y" * 1000])
    assert len(rows) == 5 and (rows[:, -1] % 256 == ord("y")).all()  # the chunks reach the end


def test_quality_of_messy_rows(spark, messy, empty):
    labels = spark.createDataFrame([(1, 0), (2, 1), (100, 1), (101, 0), (101, None), (None, 1), (9999, 0)], "doc_id long, quality int")
    for docs, known in ((messy, labels), (messy, labels.limit(0)), (empty, labels)):
        net = quality_cnn.fit(docs, known)
        scores = [r["s"] for r in docs.select(quality_cnn.quality_score(F.col("text"), net).alias("s")).collect()]
        assert len(scores) == docs.count() and all(0 <= s <= 1 for s in scores)


def test_language_on_held_out_rows(spark):
    from corpusflow.llm.queries import QUERIES
    got = QUERIES["op7_language_centroids"](spark, SF01).collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    checked = [lang[r["doc_id"]] == r["lang_pred"] for r in got if r["held_out"]]
    assert len(checked) > 100 and np.mean(checked) >= 0.97


def test_numerals_are_no_letters(spark):
    model = language.fit(spark.read.parquet(f"{SF01}/documents.parquet"), per_language=20)
    rows = spark.createDataFrame([(t,) for t in ("½²", "Ⅷ ⅷ ③", "12 ٣ _", "½ a", "一", "é")], "text string")
    got = {r["text"]: r["o"]["lang_pred"] for r in rows.select("text", language.identify(F.col("text"), model, reject=False).alias("o")).collect()}
    assert {t for t, x in got.items() if x == "und"} == {"½²", "Ⅷ ⅷ ③", "12 ٣ _"}
    assert all((language.counts(c) is not None) == c.lower().isalpha() for c in map(chr, range(0x3000)) if len(c.lower()) == 1)


def test_language_vectors_and_centroids_equal_plain_python(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").limit(400).union(
        spark.read.parquet(f"{SF01}/documents.parquet").limit(20))
    model = language.fit(docs, per_language=30)
    train = [r for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 and r["lang"] is not None and r["text"] is not None]

    def grams(text):
        letters = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        b = (" " + " ".join(letters) + " ").encode()
        return collections.Counter(((b[i] | b[i + 1] << 8 | b[i + 2] << 16) * 2654435761 % 2 ** 32) >> (32 - language.WIDTH_BITS)
                                   for i in range(len(b) - 2)) if letters else {}

    seen, n = collections.Counter(), 0
    for r in train:
        g = grams(r["text"])
        seen.update(g.keys())
        n += bool(g)
    idf = np.array([np.log((1 + n) / (1 + seen[s])) + 1 for s in range(1 << language.WIDTH_BITS)])
    assert np.allclose(model.idf, idf, atol=1e-5)
    got = docs.select("text", language.identify(F.col("text"), model, reject=False).alias("o")).collect()
    centroids = model.centroids.astype(np.float64)
    for r in got:
        v = np.zeros(1 << language.WIDTH_BITS)
        for s, c in grams(r["text"] or "").items():
            v[s] = np.log1p(c) * idf[s]
        if v.any():
            near = centroids @ (v / np.linalg.norm(v))
            assert abs(near.max() - r["o"]["score"]) < 1e-4
            assert near[[k for k, x in enumerate(model.languages) if x == r["o"]["lang_pred"]]].max() > near.max() - 1e-4
    assert len(model.languages) == len(set(r["lang"] for r in train)) * language.CENTROIDS


def test_a_stretch_the_library_encodes_otherwise_falls_back(spark, monkeypatch):
    e, library = Encoder(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    agenda = e.vocabulary.agenda
    monkeypatch.setattr(e.vocabulary, "agenda", lambda words: [b"\0\0\0\0" if w == "▁wrong" else x for w, x in zip(words, agenda(words))])
    got = e.encode_noting(["all is wrong here", "all is well here"])
    assert [noted for _, noted in got] == [True, False]
    assert [np.frombuffer(b, "<u4").tolist() for b, _ in got] == library.encode(["all is wrong here", "all is well here"])


def test_language_of_messy_rows(spark, messy, empty):
    model = language.fit(messy)
    rows = messy.select("text", language.identify(F.col("text"), model, reject=False).alias("o")).collect()
    for r in rows:
        lettered = any(c.isalpha() for c in r["text"] or "")
        assert (r["o"]["lang_pred"] in model.languages) if lettered else (r["o"]["lang_pred"], r["o"]["score"]) == ("und", 0.0)
    none = language.fit(empty)
    assert none.languages == []
    assert {r["o"]["lang_pred"] for r in messy.select(language.identify(F.col("text"), none).alias("o")).collect()} == {"und"}


def test_far_texts_are_rejected(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    model = language.fit(docs)
    far = spark.createDataFrame([("这是一个完全不同的语言",), ("zzqx vvkw jjxq qqzx",)], "text string")
    got = far.select(language.identify(F.col("text"), model).alias("o"), language.identify(F.col("text"), model, reject=False).alias("p")).collect()
    assert all(r["o"]["rejected"] and r["o"]["lang_pred"] == "und" and r["p"]["lang_pred"] != "und" for r in got)


def test_no_paragraph_without_a_telling_pair_can_be_confirmed():
    pairs = set(telling())
    for family in TEMPLATES.values():
        for t in family:
            grams = set(two_grams(template_words(t)))
            assert len(grams - pairs) < CONFIRM * len(grams)


def test_licenses_are_found(spark, messy, empty):
    planted = {"mit": "Released under the MIT License.", "apache": "Licensed under the Apache License, Version 2.0.", "cc-by-nc": "Licensed under CC BY-NC 4.0.",
               "gpl": "This work is licensed under the GNU General Public License, version 3.", "proprietary": "All rights reserved."}
    rows = [(500 + i, f"some first line\n{p}\nand a last one") for i, p in enumerate(planted.values())]
    rows += [(600, "we walked under the apache helicopter and the license plate"), (601, "the rights of all people were reserved for later"),
             (602, planted["mit"] + "\n" + planted["gpl"]), (602, planted["mit"] + "\n" + planted["gpl"]), (603, "nothing here")]
    docs = messy.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("family", F.lit(1))
    got = collections.defaultdict(list)
    for r in scan_licenses(docs).collect():
        got[r["id"]].append((r["families"], r["n_license"]))
    for i, name in enumerate(planted):
        assert got[500 + i] == [(name, 1)]
    assert got[600] == [("", 0)] and got[601] == [("", 0)] and got[602] == [("gpl|mit", 2)] * 2 and got[603] == [("", 0)]
    assert sum(map(len, got.values())) == docs.count()
    assert scan_licenses(empty).count() == 0


#: Openings of notices as programs carry them, and their families.
NOTICES = {
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
           "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
            "as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
           "(the \"Software\"), to deal in the Software without restriction",
    "apache": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."}


def test_notices_are_found_however_they_are_wrapped(spark):
    rows, want = [], {}
    for k, (family, text) in enumerate(NOTICES.items()):
        for j, shape in enumerate((text, "\n".join("# " + x for x in textwrap.wrap(text, 72)), "\n".join(textwrap.wrap(text, 30)))):
            want[10 * k + j] = family
            rows.append((10 * k + j, f"one line before it\n{shape}\nand one after"))
    rows.append((900, "\n".join(textwrap.wrap(" ".join(NOTICES[f] for f in ("gpl", "lgpl", "bsd")), 72))))
    rows.append((901, "Released under the MIT License\nLicensed under CC BY 4.0"))
    rows.append((902, NOTICES["mit"] + "\n \t\n" + NOTICES["mit"]))
    plain = [(i, t) for i, t in rows if i % 10 == 0 or i > 899]
    wrapped = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: (r["families"], r["n_license"]) for r in scan_licenses(wrapped).collect()}
    assert {i: got[i] for i in want} == {i: (f, 1) for i, f in want.items()}
    assert got[900] == ("bsd|gpl|lgpl", 3) and got[901] == ("cc-by|mit", 2) and got[902] == ("mit", 2)
    alone = {r["id"]: (r["families"], r["n_license"]) for r in scan_licenses(spark.createDataFrame(plain, "doc_id long, text string")).collect()}
    assert alone == {i: got[i] for i in alone}


def brute_windows(text):
    """(paragraph, template n-grams) of every window of a text."""
    gate, vocab, (lead, sizes) = set(telling()), set(vocabulary()), reach()
    out = set()
    for p, run in enumerate(re.split("\n[\t-\r ]*\n", text or "")):
        words = [w for w in re.split("[^a-z0-9]+", run.lower()) if w]
        for i, pair in enumerate(two_grams(words)):
            if pair in gate:
                for n in sizes:
                    w = words[max(0, i - lead):i + n]
                    out.add((p, tuple(sorted({g for g in [*w, *two_grams(w)] if g in vocab}))))
    return out


def test_windows_and_coverage_match_brute_force(spark, messy):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text")
    extra = [(10**6 + i, "\n\n".join(textwrap.fill(t, 40) for t in [*NOTICES.values()][i:])) for i in range(5)]
    docs = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string")).unionByName(messy.select("doc_id", "text"))
    families = sorted(TEMPLATES)
    want = {(r["doc_id"], p, g) for r in docs.collect() for p, g in brute_windows(r["text"])}
    ids = docs.select("doc_id", *row_digest("doc_id", "text")).distinct()
    got = windows(docs, "doc_id", "text").join(ids, ["_d1", "_d2"]).select("doc_id", "_para", "_grams", coverage(F.col("_grams"), families).alias("_c")).collect()
    assert {(r["doc_id"], r["_para"], tuple(r["_grams"])) for r in got} == want and len(want) > 100
    shares = {f: [set(two_grams(template_words(t))) for t in TEMPLATES[f]] for f in families}
    for r in got:
        assert r["_c"] == [max(len(t & set(r["_grams"])) / len(t) for t in shares[f]) for f in families]


def test_licenses_over_the_test_documents(spark):
    from corpusflow.llm.queries import QUERIES
    notices = {"mit": "Released under the MIT License.", "apache": "Licensed under the Apache License, Version 2.0.", "cc-by-nc": "Licensed under CC BY-NC 4.0.",
               "gpl": "This work is licensed under the GNU General Public License, version 3.", "proprietary": "All rights reserved."}
    want = {r["doc_id"]: "|".join(sorted(k for k, v in notices.items() if v in r["text"])) for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    got = {r["doc_id"]: r["families"] for r in QUERIES["op10_license_scan"](spark, SF01).collect()}
    assert np.mean([got[i] == w for i, w in want.items()]) >= 0.99
