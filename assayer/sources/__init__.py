"""Readers and writers: file trees, JSON, annotations, rasters, volumes, archives, exports."""
