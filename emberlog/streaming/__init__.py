"""Streaming of reports that arrive in a folder."""
