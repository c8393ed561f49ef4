"""Bounded Arrow batches for stages that see whole texts."""

from refrain.operators.batches import MOST_BYTES, MOST_ROWS, bounded_batches

__all__ = ["MOST_BYTES", "MOST_ROWS", "bounded_batches"]
