"""Spark-native analytics over keyed, ordered streams, and operators for text corpora."""
