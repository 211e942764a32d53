"""threadlens: Spark-native operators for support-conversation analytics.

Every public operator takes and returns DataFrames and stays lazy, except the
iterative graph operators (thread roots and reachability), the classifier fit
and the streaming driver, which need actions by nature.
"""

from threadlens.session import build_session, ensure_checkpoint_dir

__all__ = ["build_session", "ensure_checkpoint_dir"]
