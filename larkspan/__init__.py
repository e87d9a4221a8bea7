"""DataFrame operators and jobs for listings, document registries, document
corpora, messages and retrieval, written for Spark."""
