"""Running tasks of a tier through a worker, with retries, repair and resume."""
