"""PySpark-native analytics for time-lapse microwell experiments."""
