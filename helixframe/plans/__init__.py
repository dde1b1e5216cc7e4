"""Models: from a parameter vector to scenes that the engine evaluates."""
