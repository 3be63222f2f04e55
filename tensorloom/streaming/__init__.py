"""Gulps, lost and late data, and state carried along a stream."""
