"""Operational monitors over scored event streams (batch and Structured Streaming forms)."""
