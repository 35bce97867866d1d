"""Reading and writing papers, example shards, manifests and metrics."""
