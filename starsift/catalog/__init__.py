"""Named queries over the benchmark tables and their SQL counterparts."""

from starsift.catalog import cleaning, endtoend, evaluation, files, modelling, relational, sequences, texts  # noqa: F401
from starsift.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
