"""DataFrame-to-DataFrame operators on position reports, paths, lines, rasters and scenarios."""
