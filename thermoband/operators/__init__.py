"""Operators over DataFrames: cleaning, bands, deviations, summaries, grids, smoothing."""
