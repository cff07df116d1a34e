"""Relational operators: de-duplication, quotas, features, scoring, evaluation."""
