"""Training-data operators: one module for each, a registry of their queries, and shared helpers."""
