"""op13: all documents as token pieces, packed into sequences of 2,048."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from corpusflow.llm.bin_packing import pack, token_pieces
from corpusflow.llm.common import table
from corpusflow.llm.registry import query


@query("op13_best_fit_packing")
def op13_best_fit_packing(spark, sf_dir):
    pieces = token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=0, capacity=2048)
    # the digest here and not after packing, so that the ids don't travel with the rows
    narrow = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "part", "nth")
    return pack(narrow, capacity=2048)
