"""wattle: ledger and location analytics as Spark DataFrame jobs.

Every public function takes DataFrames (plus plain parameters) and returns a
DataFrame.  Nothing runs an action unless its docstring says so (the iterative
nearest-neighbour search is the one exception).
"""

from wattle.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
