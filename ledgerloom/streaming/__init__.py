"""Structured Streaming forms of the lifecycle fold, the outbox and the metrics.

Each micro-batch writes its own folder by batch id, so a batch that runs again after a failure replaces
itself: delivery is at least once, effects happen once.
"""
