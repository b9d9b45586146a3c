"""River-network analytics on Spark: routed forests, graph queries, overlays and exports."""
