"""Readers and writers of point clouds, tiles, grids and run histories."""
