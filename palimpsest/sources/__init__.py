"""Storage: an append-only Parquet log published through manifests."""
