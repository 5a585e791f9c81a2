"""Named queries over the driver tables, each with its DuckDB oracle SQL.

Importing this package registers every query module; ``QUERIES`` maps a name
to ``(spark, sf_dir) -> DataFrame`` and ``ORACLE`` maps it to SQL.
"""

from corpusflow.plans.registry import ORACLE, QUERIES  # noqa: F401
from corpusflow.plans import (  # noqa: F401
    q_sampling,
    q_schema,
    q_profile,
    q_text,
    q_budget,
    q_eval,
    q_matrix,
    q_analytics,
    q_stream,
)
