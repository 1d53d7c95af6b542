"""Micro-batches and keyed state."""
