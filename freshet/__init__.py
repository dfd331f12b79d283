"""freshet: flood-network analytics and corpus preparation on Spark DataFrames."""
