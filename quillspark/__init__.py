"""A Spark-native search and analytics engine with a browsing query language."""
