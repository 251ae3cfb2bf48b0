"""Relations: catalog, files, synthetic data and column statistics."""
