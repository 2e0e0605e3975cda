"""Spark jobs over raster road grids, places and location streams."""
