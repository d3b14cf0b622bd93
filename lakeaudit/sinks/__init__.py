"""Sinks: the manifest store (K1-K4) and JSON lines (K5)."""
