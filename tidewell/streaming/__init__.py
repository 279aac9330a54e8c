"""Streams of events: windows by event time and sessions with state, in tables that equal what a batch over the same rows gives."""
