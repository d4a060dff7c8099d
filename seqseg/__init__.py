"""seqseg - segmentation and labelling of ordered records as Spark jobs.

An *episode* is a sequence of frames (events, turns, ...). Tables are keyed by
``(dataset, episode_index)`` and ordered by a dense, zero-based ``frame_index``.
Every operator is a function from DataFrames to a DataFrame; nothing is collected
on the driver and no step needs a whole episode in one task (see
``seqseg.operators.ordered``).
"""

from seqseg.session import build_session

__all__ = ["build_session"]
