"""Document-structure analytics and text preparation on Spark DataFrames."""
