"""orgweave: Spark-native evidence analytics over captured pages and business tables."""
