"""DataFrame operators: edges, deduplication, aggregates, ranking, lookups, graph algorithms."""
