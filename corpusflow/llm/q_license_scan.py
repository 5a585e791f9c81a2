"""op10: licence families in all documents."""

from __future__ import annotations

from corpusflow.llm.common import table
from corpusflow.llm.license_scan import scan_licenses
from corpusflow.llm.registry import query


@query("op10_license_scan")
def op10_license_scan(spark, sf_dir):
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")
