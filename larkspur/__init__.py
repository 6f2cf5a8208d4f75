"""larkspur: a Spark-native analytics engine for valuation and corpus tables."""
