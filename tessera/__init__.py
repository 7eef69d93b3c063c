"""Raster and corpus analytics written as Spark DataFrame plans."""
