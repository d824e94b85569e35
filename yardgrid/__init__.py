"""Player-tracking analytics on Spark: DataFrame in, DataFrame out."""
