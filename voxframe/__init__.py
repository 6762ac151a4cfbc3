"""Spark-native volume analytics: tiling, pyramids, fields, sketches and passes as DataFrame plans."""
