"""Tables on storage: Parquet snapshots with atomic replacement."""
