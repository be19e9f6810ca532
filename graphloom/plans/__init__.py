"""Compositions: views over relational tables, crawl, enrichment, unification, questions and answers."""
