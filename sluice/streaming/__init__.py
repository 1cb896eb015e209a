"""Structured Streaming: landed page streams (S3) and push events."""
