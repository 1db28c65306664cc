"""Registered queries over the given tables, each beside its SQL check."""
from catalog import retrieval, intake, ledger, governance, access, digestion, telemetry  # noqa: F401,I001
from catalog.base import QUERIES, SQL  # noqa: F401
