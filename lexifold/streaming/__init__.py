"""No streaming operator is provided: the computed work has no windows, watermarks or keyed state.

``lexifold.plans.ingest`` is idempotent by content hash, so a ``foreachBatch``
sink may call it as it is.
"""
