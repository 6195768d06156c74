"""Lossless animation data as tables: movies, frames, pixels and their operators on Spark."""
