"""Operators of a training-data pipeline; nothing else in the library imports them."""

from ledgerline.llm import decontaminate, html, langid, lines, merkle, negatives, packing, phrases, quality, simhash, tokens, toxicity, warc  # noqa: F401  (they register their queries)
from ledgerline.llm.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
