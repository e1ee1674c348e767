"""Relational operators of the archive: assembly, readiness, cohorts, catalog, enrichment, upkeep."""
