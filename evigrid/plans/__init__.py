"""Plan-level helpers: cutting lineage, keyed layouts."""
