"""DataFrame-to-DataFrame operators over frames, blocks, boxes and tracks."""
