"""placeloom: spatial and text feature engineering for point tables, as Spark DataFrame jobs."""
