"""Queries: operators applied to the tables, each with its SQL twin where SQL can express it."""

from skein.plans import audit, duplicates, joins, quality, report, sequences, statistics, textual

_PARTS = (quality, report, audit, duplicates, joins, statistics, sequences, textual)
QUERIES = {k: q for part in _PARTS for k, q in part.R.queries.items()}
ORACLES = {k: q for part in _PARTS for k, q in part.R.oracles.items()}
