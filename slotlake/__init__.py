"""Content-addressed object data as DataFrames: identity, index logs, placement, chunking, packing."""
