"""A Spark-native engine for tri-axial wearable-sensor time series."""
