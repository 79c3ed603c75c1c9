"""How many partitions rows need; checkpoints are the engine's."""

from __future__ import annotations

import math

from ..checkpoints import checkpointed, ensure_checkpoint_dir

__all__ = ["checkpointed", "ensure_checkpoint_dir", "parts"]


def parts(rows: int, each: int) -> int:
    """Partitions for rows when each should hold about ``each``."""
    return max(1, math.ceil(rows / each))
