"""Property-graph analytics over source estates, as DataFrame plans."""
