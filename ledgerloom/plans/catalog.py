"""All queries of the library with their SQL oracles."""

from __future__ import annotations

from ledgerloom.plans import amendments, checks, features, figures, filings, language, relational, reviews, scores, text

_BOOKS = (text, relational, figures, scores, language, filings, reviews, amendments, checks, features)
QUERIES: dict = {k: v for b in _BOOKS for k, v in b.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for b in _BOOKS for k, v in b.ORACLES.items()}
