"""Extension beyond the declared operators: predictions that arrive as a stream."""
