"""Scalar functions: times, the sphere, grid cells."""
