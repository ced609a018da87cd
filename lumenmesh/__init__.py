"""lumenmesh: spatial network planning and data processing on PySpark."""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
