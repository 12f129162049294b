"""Column expressions: boxes, grid cells, geometry, text, vectors, schedules."""
