"""DataFrame operators: analysis, requests, matching, ranking, graph, names, vectors."""
