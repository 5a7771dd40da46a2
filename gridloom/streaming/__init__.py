"""Operators on streams of voxel rows."""
