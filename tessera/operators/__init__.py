"""Data-frame operators: binning, series, geometry, grids, neighbours, moments, peaks, fits."""
