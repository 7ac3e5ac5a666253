"""Spark-native analytics over keyed training-data records."""
