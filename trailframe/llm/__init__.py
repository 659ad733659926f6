"""Operators for training-data pipelines (see :mod:`trailframe.llm.queries`)."""
