"""End-to-end jobs composed from operators: index, search, hits, cluster."""
