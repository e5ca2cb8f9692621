"""Spark jobs for photon event lists, sky maps, counts statistics, light curves and source catalogs."""
