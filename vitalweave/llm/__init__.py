"""Operators for text corpora; ``queries.PLANS`` has their registered queries."""
