"""Filing fundamentals on Spark: operators, sources and reports as DataFrame programs."""
