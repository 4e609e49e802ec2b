"""Population matching and causal-balance analytics on Spark."""
