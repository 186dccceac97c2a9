"""barline: cross-sectional time-series analytics on Spark."""
