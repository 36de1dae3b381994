"""DataFrame -> DataFrame jobs: models, quality checks, ingest, retrieval."""
