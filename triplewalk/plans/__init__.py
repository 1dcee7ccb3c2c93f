"""Parameter grids, presets, and the queries over the driver's tables."""
