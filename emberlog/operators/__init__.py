"""Operators over frames of builds, failures, findings and runs."""
