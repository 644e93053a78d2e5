"""Darts scoring on Spark: DataFrame in, DataFrame out."""
