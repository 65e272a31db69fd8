"""Column expressions and vectorised functions of points."""
