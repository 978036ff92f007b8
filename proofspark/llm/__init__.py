"""Training-data operators: DataFrame in, DataFrame out."""
