"""Runnable cases on the benchmark tables, each beside the SQL it must agree with."""

from ledgerline.plans.cases import files, jobs, ledgers, links, stored, texts  # noqa: F401  (they register their cases)
from ledgerline.plans.cases.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
