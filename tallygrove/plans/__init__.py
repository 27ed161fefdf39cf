"""Plans: whole audits, and the catalogue of queries with their oracle SQL."""
