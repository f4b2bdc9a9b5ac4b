"""Readers and writers, and views of general tables as frames, blocks and boxes."""
