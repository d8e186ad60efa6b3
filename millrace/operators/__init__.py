"""DataFrame operators: retrieval, fusion, reranking, evidence, caching, metrics."""
