"""pathwise: ordered label trajectories and corpus work as Spark jobs."""
