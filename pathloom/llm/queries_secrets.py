"""The query that scans every document for secrets."""

from __future__ import annotations

from pathloom.llm import secrets
from pathloom.llm.common import table
from pathloom.llm.registry import query


@query("op12_secrets")
def secret_scan(spark, sf_dir):
    return secrets.digests(secrets.scan(table(spark, sf_dir, "documents")))
