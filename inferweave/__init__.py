"""A knowledge-graph reasoning and data-processing engine on Spark DataFrames."""
