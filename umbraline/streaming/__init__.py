"""Stateful operators over streams; fed row by row they give what the batch operators give."""
