"""Structured Streaming forms of log and corpus operators."""
