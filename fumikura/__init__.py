"""fumikura: quantitative analysis of large text corpora on Spark."""
