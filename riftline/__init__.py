"""Spark-native segmentation of numeric streams, and a corpus toolkit in ``riftline.llm``."""
