"""runloom: run-length compressed N-dimensional arrays and corpus operators as Spark jobs."""
