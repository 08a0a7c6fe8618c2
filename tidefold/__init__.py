"""Series, grids, ensembles and corpora as Spark jobs."""
