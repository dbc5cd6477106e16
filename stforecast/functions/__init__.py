"""Column expressions and the small numpy helpers that run inside Spark tasks."""
