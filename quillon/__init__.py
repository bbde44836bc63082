"""Graph, signal, orbit and terrain analytics as Spark DataFrame functions."""
