"""Streaming lowerings of the stateful operators."""
