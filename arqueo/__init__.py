"""Treasury analytics as Spark batch jobs: DataFrames in, DataFrames out."""
