"""lantern: structural graph analytics and data-processing operators on Spark DataFrames."""
