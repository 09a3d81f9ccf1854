"""Operators over rank-addressed buffers."""

import time

from .communicator import Movement, Reductions, Result
from .groups import Communicators, Group, RankRange
from .p2p import PointToPoint
from .plugins import Failures, Reproducible, Sorting, Sparse


class Communicator(Movement, Reductions, Communicators, PointToPoint, Sorting, Sparse, Reproducible, Failures):
    """All operations; plugins are further mixin classes, and on_error may be overridden."""

    def on_error(self, error: Exception):
        raise error

    def abort(self, reason: str = "aborted"):
        """Cancels all Spark jobs and raises."""
        self.spark.sparkContext.cancelAllJobs()
        self.on_error(RuntimeError(reason))


class Environment:
    """What holds for a session: tags, a clock."""

    #: Tags are 32-bit integers from 0 on.
    tag_upper_bound = (1 << 31) - 1

    @classmethod
    def is_valid_tag(cls, tag: int) -> bool:
        return 0 <= tag <= cls.tag_upper_bound

    @staticmethod
    def wtime() -> float:
        """Seconds since some time in the past."""
        return time.perf_counter()

    @staticmethod
    def wtick() -> float:
        """The clock's resolution in seconds."""
        return time.get_clock_info("perf_counter").resolution


def comm_world(spark, size: int | None = None) -> Communicator:
    """The default communicator: as many ranks as the cluster runs tasks at once, or `size`."""
    return Communicator(spark, size or spark.sparkContext.defaultParallelism)


def world_size(spark) -> int:
    return comm_world(spark).size


__all__ = ["Communicator", "Environment", "Group", "RankRange", "Result", "comm_world", "world_size"]
