"""DataFrame operators: search, link graph, cache, documents, roll-ups, review and clusters."""
