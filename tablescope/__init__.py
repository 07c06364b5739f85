"""tablescope: table profiling and AutoML analytics written as Spark jobs."""
