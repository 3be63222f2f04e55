"""Operators on tensor streams, each a function ``TensorFrame -> TensorFrame``."""
