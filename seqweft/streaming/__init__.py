"""Streaming forms of window sealing and ordered emission."""
