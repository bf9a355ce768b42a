"""Scalar column functions and data generators."""
