"""listingflow: Spark-native refinement of semi-structured listing records."""
