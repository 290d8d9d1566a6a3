"""Streams of points, located batch by batch. Location needs no state: each micro-batch meets the static mesh as a table does."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter


def locate_stream(points: DataFrame, locate: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """A writer, to be started, that locates each micro-batch of the streaming table ``points`` and hands it to ``write``.

    locate: points to located points, such as ``lambda p: locate.planar(p, triangles)``. write: gets a batch's result and its
    number; with a number that it has written before it should write again over that, as a batch may come twice.
    checkpoint: a folder that all machines share.
    """
    return points.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, n: write(locate(batch), n))
