"""Training-data operators: dedup, tokenisation, filtering, packing, extraction and sharding of document tables."""
