"""Collections of documents as versioned Parquet datasets."""
