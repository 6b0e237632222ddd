"""Following a source at an interval that adapts to what comes."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame


class Pace:
    """Seconds to wait after each look: ``base``; from the ``patience``-th look in a row that
    found nothing, twice as long as before, up to ``most``; ``base`` again after a find."""

    def __init__(self, base: float, patience: int = 3, most: float = 300):
        self.base, self.patience, self.most = base, patience, most
        self.wait, self.empty = base, 0

    def after(self, found: int) -> float:
        if found:
            self.wait, self.empty = self.base, 0
        else:
            self.empty += 1
            if self.empty >= self.patience:
                self.wait = min(self.wait * 2, self.most)
        return self.wait


def follow(
    stream: Callable[[], DataFrame], checkpoint: str, sink: Callable[[DataFrame, int], None], base: float = 30, patience: int = 3, most: float = 300, mode: str = "append",
    stop: threading.Event | None = None, looks: int | None = None, pause: Callable[[float], object] | None = None,
) -> list[tuple[int, float]]:
    """Looks for new rows, takes all there are, and waits; until ``stop`` is set or after so
    many ``looks``.  Each look is a run of the streaming query over what is available, from
    its checkpoint, so nothing runs between looks and a crash loses nothing.  A look that
    fails counts as one, is waited for ``base`` seconds and tried again; the second failure
    in a row is raised.  Returns (rows found, seconds waited) of the last 100 looks.
    """
    pace, stop, seen, failed = Pace(base, patience, most), stop or threading.Event(), [], False
    pause = pause or stop.wait
    while not stop.is_set() and (looks is None or looks > 0):
        try:
            q = stream().writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()
            q.awaitTermination()
            found, failed = sum(p.numInputRows for p in q.recentProgress), False
            wait = pace.after(found)
        except Exception:
            if failed:
                raise
            found, wait, failed = 0, base, True
        seen = [*seen[-99:], (found, wait)]
        looks = None if looks is None else looks - 1
        if looks != 0:
            pause(wait)
    return seen
