"""Sinks: rendered documents and run stores."""
