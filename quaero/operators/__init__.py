"""DataFrame operators: resolution, views, search, recall, vectors, aggregates, edits."""
