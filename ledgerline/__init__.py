"""A PySpark-native analytics library for commercial-credit data."""
