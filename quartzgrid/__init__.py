"""quartzgrid: Spark-native Z-order point compaction and analytics."""

__version__ = "0.1.0"
