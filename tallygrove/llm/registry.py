"""Queries and oracle SQL of this subpackage, by name."""

from . import alignment, langid, mixing, neighbours, passages, pieces, pii, quality, secrets, simhash, spelling, spotsigs, vecdups

MODULES = (alignment, langid, mixing, neighbours, passages, pieces, pii, quality, secrets, simhash, spelling, spotsigs, vecdups)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}
