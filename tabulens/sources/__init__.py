"""Readers, catalog, file checks, samples and sinks."""
