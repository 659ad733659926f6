"""trailframe: movement analytics on point data as Spark DataFrame plans."""

__version__ = "0.1.0"
