"""A PySpark engine for ordered coordinate data: trajectories, structures, series and networks."""
