"""Readers and writers of the text formats, and the fixtures made from the driver tables."""
