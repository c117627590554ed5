"""Column functions and NumPy numerics without Spark."""
