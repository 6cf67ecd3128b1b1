"""Structured Streaming forms: corpus stream preparation and the stateful liquid filter."""
