"""Readers and writers of signal files and packets."""
