"""Streams: the event inbox and micro-batch upserts."""
