"""stackloom: Spark jobs for continuous-profiling data at fleet scale."""
