"""Column-level rules: names, dates, coordinates, map projections."""
