"""Training-data operators: extraction, labelling, deduplication, sampling and packing on Spark."""
