"""Spark-native analytics over corpora of logic graphs: metadata, graphs, splits, predictors and evaluation."""
