"""Sparse voxel-video analytics on PySpark."""
