"""Review analytics on Spark: load, join, search, summarise and model product reviews."""
