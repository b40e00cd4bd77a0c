"""Electronic-nose recording analytics as lazy Spark DataFrame transformations."""
