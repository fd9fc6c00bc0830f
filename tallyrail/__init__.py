"""Stream analytics over captured prediction-market feeds, on Spark DataFrames."""
