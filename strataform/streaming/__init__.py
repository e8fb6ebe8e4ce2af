"""Streams of edges and events."""
