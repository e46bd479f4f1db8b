"""Column expressions: distances, gradients, learning rates."""
