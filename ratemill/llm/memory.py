"""What a Python worker remembers between its tasks."""

from __future__ import annotations

_kept: dict[str, dict] = {}


def remembered(owner: str) -> dict:
    """The memory of one operator in this worker. Whatever another operator left is dropped first.

    Workers live on when a stage ends, so memories of several operators would add up.
    """
    if owner not in _kept:
        import gc

        import pyarrow as pa

        _kept.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _kept[owner] = {}
    return _kept[owner]
