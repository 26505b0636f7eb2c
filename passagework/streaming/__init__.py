"""Documents that arrive in pieces."""
