"""PySpark-native analytics for scientific-literature corpora."""
