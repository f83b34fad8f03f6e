"""lattiq: Spark-native analytics over code graphs."""
