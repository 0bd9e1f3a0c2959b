"""tablewash: cleaning, profiling and scoring tables as Spark jobs."""
