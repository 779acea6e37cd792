"""A barrier for processes that share nothing but a folder (G2). Spark jobs don't need it; launchers around them may."""

from __future__ import annotations

import time
from dataclasses import dataclass
from pathlib import Path


@dataclass(frozen=True)
class FileBarrier:
    """``wait`` returns once all ``world_size`` ranks have called it for the same folder and name; names are used once."""

    folder: str
    rank: int
    world_size: int
    timeout: float = 600.0
    poll: float = 0.05

    def __post_init__(self) -> None:
        if self.world_size < 1 or not 0 <= self.rank < self.world_size:
            raise ValueError(f"rank {self.rank} is none of {self.world_size}")
        if self.timeout <= 0 or self.poll <= 0:
            raise ValueError("timeout and poll must be > 0")

    def wait(self, name: str) -> None:
        at = Path(self.folder) / name
        at.mkdir(parents=True, exist_ok=True)
        (at / str(self.rank)).touch()
        end = time.monotonic() + self.timeout
        while missing := [r for r in range(self.world_size) if not (at / str(r)).exists()]:
            if time.monotonic() > end:
                raise TimeoutError(f"ranks {missing} have not come to {name}")
            time.sleep(self.poll)
