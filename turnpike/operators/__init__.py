"""DataFrame operators: pure functions from frames to frames."""
