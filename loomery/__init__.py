"""loomery: web-content analytics and corpus preparation on Spark DataFrames."""
