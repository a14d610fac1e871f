"""Training-data operators: filters, scans, deduplication, mixing and packing of text corpora."""
