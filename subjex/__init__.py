"""subjex: subject indexing and domain classification as Spark DataFrame jobs.

Every public function takes and returns DataFrames (or Columns); nothing is
collected to the driver except scalar statistics (counts, averages).
"""

from subjex.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
