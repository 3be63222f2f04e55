"""Chains of operators as programs."""
