"""PySpark-native product-catalog integration and price analytics."""
