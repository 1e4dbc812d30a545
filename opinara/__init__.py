"""Review analytics, hybrid recommendation and corpus preparation on Spark."""
