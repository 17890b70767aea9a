"""Evidence analytics on Spark: provenance, temporal and text operators as DataFrame plans."""
