"""lendflow: bulk mortgage-application assessment as Spark DataFrame jobs.

Layout
------
``sources``    readers, schemas, quarantine and the views derived from the driver tables
``functions``  Column -> Column building blocks (metrics, text formatting, masking, vectors)
``operators``  DataFrame -> DataFrame operators (policy, ledger, retrieval, decisions, ...)
``plans``      the registered queries and their DuckDB oracle SQL, plus the batch assessment job
``streaming``  Structured Streaming forms of the assessment and ledger jobs
"""

from lendflow.params import PolicyParams, DEFAULT_POLICY

__all__ = ["PolicyParams", "DEFAULT_POLICY"]
