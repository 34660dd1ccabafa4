"""Spark jobs for rasters, meshes, ensembles, series and stored web data."""
