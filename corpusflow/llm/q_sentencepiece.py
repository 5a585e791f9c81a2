"""op8: SentencePiece ids and decoded texts of all documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from corpusflow.llm.common import table
from corpusflow.llm.registry import query
from corpusflow.llm.sentencepiece_bpe import encode_decode


@query("op8_sentencepiece")
def op8_sentencepiece(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = encode_decode(F.col("text"), public_tokenizers.path("piece_bpe_32k.model"))
    return docs.select("doc_id", out.alias("_out")).select("doc_id", "_out.*")
