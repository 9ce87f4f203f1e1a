"""Reports and pipelines composed from sources, operators and functions."""
