"""What a run says, kept beside its output: log lines as they go by, facts, and timings by falling share."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from weftnet.sources.writers import report


class RunLog(logging.Handler):
    """Within a `with` block, keeps every line of the named loggers; they still go where they went before."""

    def __init__(self, *names: str) -> None:
        super().__init__(logging.INFO)
        self.setFormatter(logging.Formatter("%(asctime)s %(name)s %(levelname)s %(message)s"))
        self.loggers = [logging.getLogger(n) for n in names or ("weftnet", "jobs")]
        self.lines: list[str] = []
        self.timings: dict[str, float] = {}
        self._levels: list[int] = []

    def emit(self, record: logging.LogRecord) -> None:
        self.lines.append(self.format(record))

    def __enter__(self) -> RunLog:
        self._levels = [x.level for x in self.loggers]
        for x in self.loggers:
            x.addHandler(self)
            x.setLevel(min(x.level or logging.INFO, logging.INFO))
        return self

    def __exit__(self, *_: object) -> None:
        for x, level in zip(self.loggers, self._levels, strict=True):
            x.removeHandler(self)
            x.setLevel(level)

    @contextmanager
    def step(self, name: str) -> Iterator[None]:
        """Time a named step; a step that is entered again adds up."""
        self.loggers[0].info("starting: %s", name)
        began = time.time()
        try:
            yield
        finally:
            self.timings[name] = self.timings.get(name, 0.0) + time.time() - began
            self.loggers[0].info("finished: %s in %.1f s", name, self.timings[name])

    def save(self, spark: SparkSession, path: str, info: dict[str, object] | None = None) -> None:
        """`log` and `report` below the path, a line a row; a run says at most some thousand lines."""
        for name, lines in (("log", self.lines), ("report", report(info or {}, self.timings).split("\n"))):
            spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}")
