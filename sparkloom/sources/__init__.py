"""Readers and writers: tagged edge files, PNG rasters, timing and result files."""
