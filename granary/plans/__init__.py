"""Plan-level helpers: lineage cuts, skew-safe ranks, connected components, pipelines."""
