"""Survey-text analytics on Spark: DataFrame-to-DataFrame operators for open answers."""
