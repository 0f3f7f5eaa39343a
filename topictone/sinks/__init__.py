"""Sinks: result and report writers, prediction log."""
