"""Streams of points against static point sets."""
