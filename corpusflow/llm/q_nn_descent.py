"""op1: near-duplicate embeddings by NN-descent."""

from __future__ import annotations

from corpusflow.llm.common import table
from corpusflow.llm.nn_descent import near_duplicates
from corpusflow.llm.registry import query


@query("op1_nn_descent")
def op1_nn_descent(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), threshold=0.95)
