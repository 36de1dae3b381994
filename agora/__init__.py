"""agora: commerce analytics as Spark jobs.

Layers (see README): ``sources`` read tables and files, ``functions`` hold
Column-level helpers, ``operators`` are DataFrame -> DataFrame model and
quality jobs, ``streaming`` holds the Structured Streaming jobs, and
``plans`` wires the models into named queries.
"""

__all__ = ["session"]
