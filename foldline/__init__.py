"""Training, tuning and judging tabular regression models on Spark tables."""
