"""Streams: the engine bench state machine, windows and sessions over event logs."""
