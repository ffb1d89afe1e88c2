"""Operators on DataFrames: relational steps, ordered trajectories, votes, metrics, weekly frames, resampling."""
