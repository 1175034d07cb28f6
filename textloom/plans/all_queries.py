"""All queries over the library's own operators; importing this module registers them."""

from textloom.plans import compare_queries, function_queries, language_queries, near_queries, stream_queries, table_queries, text_queries  # noqa: F401
from textloom.plans.catalog import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
