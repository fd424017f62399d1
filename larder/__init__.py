"""Transactional buckets of ordered binary keys and values, held as immutable Parquet and read as DataFrames."""
