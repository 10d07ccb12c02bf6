"""Table-in, table-out jobs: ingest, surfaces, paths, tiles, documents, feeds."""
