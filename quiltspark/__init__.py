"""quiltspark: split-column ("disjoint") synthetic tabular data on Spark.

A table's columns are split into parts, every part is synthesised on its own,
and the parts are stitched back together row by row: by position, at random,
or through a learned validator that accepts plausible rows and recycles the
rest.  Everything is a DataFrame job; the driver only holds parameters and
small summaries (d x d correlation matrices, bucket offsets, model state).

Vocabulary: a *split* (or *part*) is a vertical slice of columns.  It has
nothing to do with Spark's horizontal partitions.
"""

from quiltspark.session import ensure_checkpoint_dir, get_spark

__all__ = ["ensure_checkpoint_dir", "get_spark"]
