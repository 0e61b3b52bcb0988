"""Structured Streaming over landed files (an extension: batch runs don't need it)."""
