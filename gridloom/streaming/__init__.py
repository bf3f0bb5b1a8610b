"""Structured Streaming counterparts of the resumable and incremental operators."""
