"""The stateless pipeline over a stream of submissions."""
