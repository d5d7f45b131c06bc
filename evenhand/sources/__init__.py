"""Readers, sinks and small registries."""
