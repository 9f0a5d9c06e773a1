"""Readers and writers: JSON-LD trees, JSON lines, vocabularies, class lists, sinks."""
