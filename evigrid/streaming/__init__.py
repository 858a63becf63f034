"""Structured Streaming: monitors, quarantine, idempotent delivery."""
