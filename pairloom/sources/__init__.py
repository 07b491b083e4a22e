"""Sources and sinks."""

from pairloom.sources.datasets import (
    contents,
    list_configs, list_splits, prune, publish, published_configs, published_splits, read_dataset,
)
from pairloom.sources.sweep_files import clean_name, read_sweep, read_sweeps

__all__ = [
    "clean_name", "contents", "list_configs", "list_splits", "prune", "publish", "published_configs", "published_splits",
    "read_dataset", "read_sweep", "read_sweeps",
]
