"""Full text: analysis, BM25 ranking, scan search, rank fusion."""
