"""A Spark-native engine for sequence binning and corpus preparation."""
