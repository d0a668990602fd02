"""Readers and writers: sections, index, reports, uploads, event lines."""
