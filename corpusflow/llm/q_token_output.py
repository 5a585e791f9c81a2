"""op3: token ids of all documents in Arrow stream files, read back."""

from __future__ import annotations

import public_tokenizers

from corpusflow.llm.common import table
from corpusflow.llm.registry import query
from corpusflow.llm.token_output import read_documents, write_sequences


@query("op3_token_sequences")
def op3_token_sequences(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return read_documents(write_sequences(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2))
