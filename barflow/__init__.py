"""barflow: Spark-native analytics over panels of time-stamped bars."""
