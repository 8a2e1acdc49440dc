"""placeweave: Spark-native collection, linking, publishing and analytics of place and activity data."""
