"""starsift: review-text analytics and rating prediction as Spark jobs."""

import sys

from pyspark import cloudpickle

from starsift.session import build_session, scratch_path

# Functions used in tasks travel with the task, so executors need no copy of the
# package and it does not matter where the driver program was started.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "scratch_path"]
