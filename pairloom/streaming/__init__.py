"""Work that arrives or is paced over time."""

from pairloom.streaming.paced import run_in_batches, write_batches

__all__ = ["run_in_batches", "write_batches"]
