"""Map-tile archives, rasters, catalogs, request statistics and feeds as Spark jobs."""
