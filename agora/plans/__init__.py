"""Wiring: the model graph over a fixture directory and the query registry."""
