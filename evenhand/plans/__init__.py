"""Compositions: whole audits, policy decisions, documents, benchmark runs."""
