"""Record linkage and table audit on Spark: DataFrame in, DataFrame out."""
