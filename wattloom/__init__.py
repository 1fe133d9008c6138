"""Spark-native silicon-power metrology: DataFrame in, DataFrame out."""
