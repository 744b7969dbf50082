"""eventweave: deterministic event-time replay, routing and time-series cleaning on PySpark."""

__version__ = "0.1.0"
