"""Quality, detection and evaluation of irregular sensor series on Spark DataFrames."""
