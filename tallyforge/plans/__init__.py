"""Queries over the driver's tables: importing this package fills the catalog."""

from . import catalog, claim_queries, invoice_queries, io_queries, line_queries, more, rule_queries, statement_queries, text_queries  # noqa: F401
