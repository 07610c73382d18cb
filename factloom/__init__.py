"""factloom: a fact-memory analytics engine on Spark DataFrames."""
