"""Reports of components: a thin layer on Python's logging, with the levels that reports have.

A component logs through `ComponentReporter`; what it logs goes to a sink of its own or, by default, to the one that `set_default_reporter`
named last, which at first is logging itself.
"""

from __future__ import annotations

import enum
import glob
import logging
import os
import time
from collections.abc import Callable
from logging.handlers import TimedRotatingFileHandler
from typing import Protocol

_ROOT = "eventweave"


class ReportLevel(enum.IntEnum):
    LARGEINFO, INFO, WARNING, SEVERE, FATAL = range(5)

    @property
    def logged(self) -> int:
        """The level of logging it stands for."""
        return (logging.DEBUG, logging.INFO, logging.WARNING, logging.ERROR, logging.CRITICAL)[self]

    def meets(self, threshold: ReportLevel) -> bool:
        return self >= threshold


class Reporter(Protocol):
    def report(self, timestamp_ms: int, source: str, message: str, level: ReportLevel) -> None: ...
    def is_enabled(self, level: ReportLevel) -> bool: ...


class CallbackReporter:
    """Calls a function (timestamp_ms, source, message, level) for reports from a level on."""

    def __init__(self, call: Callable[[int, str, str, ReportLevel], None], threshold: ReportLevel = ReportLevel.LARGEINFO) -> None:
        self.report, self.threshold = call, threshold

    def is_enabled(self, level: ReportLevel) -> bool:
        return level.meets(self.threshold)


class LoggingReporter:
    """One logger per component."""

    def report(self, timestamp_ms: int, source: str, message: str, level: ReportLevel) -> None:
        logging.LoggerAdapter(logging.getLogger(f"{_ROOT}.{source}"), {"component": source}).log(level.logged, message)

    def is_enabled(self, level: ReportLevel) -> bool:
        return logging.getLogger(_ROOT).isEnabledFor(level.logged)


_default: Reporter = LoggingReporter()


def set_default_reporter(reporter: Reporter) -> None:
    """The sink of every handle that has none of its own."""
    global _default
    _default = reporter


class ComponentReporter:
    """A component's handle. Messages may be callables, which run only if the level is wanted."""

    def __init__(self, source: str, sink: Reporter | None = None, clock: Callable[[], float] = time.time) -> None:
        self.source, self.sink, self.clock = source, sink, clock

    def log(self, level: ReportLevel, message: str | Callable[[], str]) -> None:
        sink = self.sink or _default
        if sink.is_enabled(level):
            sink.report(int(self.clock() * 1000), self.source, message() if callable(message) else message, level)


def _at(level: ReportLevel) -> Callable[[ComponentReporter, str | Callable[[], str]], None]:
    def log(self: ComponentReporter, message: str | Callable[[], str]) -> None:
        self.log(level, message)

    return log


for _name, _level in {"large_info": ReportLevel.LARGEINFO, "info": ReportLevel.INFO, "warn": ReportLevel.WARNING, "severe": ReportLevel.SEVERE, "fatal": ReportLevel.FATAL}.items():
    setattr(ComponentReporter, _name, _at(_level))


class RollingFile(TimedRotatingFileHandler):
    """A log file that rolls at midnight and at ``most_bytes``; files older than ``days`` go, and the oldest beyond ``total_bytes``."""

    def __init__(self, path: str, most_bytes: int = 50 << 20, days: int = 14, total_bytes: int = 1 << 30) -> None:
        super().__init__(path, when="midnight", encoding="utf-8", delay=True)
        self.most_bytes, self.days, self.total_bytes, self.parts = most_bytes, days, total_bytes, 0

    def shouldRollover(self, record: logging.LogRecord) -> bool:
        if super().shouldRollover(record):
            return True
        return os.path.exists(self.baseFilename) and os.path.getsize(self.baseFilename) + len(self.format(record)) + 1 > self.most_bytes

    def doRollover(self) -> None:
        if self.stream:
            self.stream.close()
            self.stream = None
        while os.path.exists(to := f"{self.baseFilename}.{time.strftime('%Y-%m-%d')}.{self.parts}"):
            self.parts += 1
        if os.path.exists(self.baseFilename):
            os.rename(self.baseFilename, to)
        self.rolloverAt = self.computeRollover(int(time.time()))
        old = sorted(glob.glob(f"{glob.escape(self.baseFilename)}.*"), key=lambda x: (os.path.getmtime(x), int(x.rsplit(".", 1)[1])), reverse=True)
        held = 0
        for x in old:
            held += os.path.getsize(x)
            if held > self.total_bytes or os.path.getmtime(x) < time.time() - self.days * 86_400:
                os.remove(x)


def configure_logging(level: ReportLevel = ReportLevel.INFO, path: str | None = None, **limits: int) -> None:
    """Lines of the form `time [LEVEL] {component} : message`, to the console or to a `RollingFile` with the limits given."""
    handler = RollingFile(path, **limits) if path else logging.StreamHandler()
    handler.setFormatter(logging.Formatter("%(asctime)s [%(levelname)s] {%(component)s} : %(message)s", defaults={"component": "-"}))
    root = logging.getLogger(_ROOT)
    for old in root.handlers:
        old.close()
    root.handlers[:] = [handler]
    root.setLevel(level.logged)
