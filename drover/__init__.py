"""drover: agent-task corpora and agent trajectories as Spark DataFrame jobs.

Operators are plain ``DataFrame -> DataFrame`` functions (usable with
``df.transform``) and column builders ``Column -> Column``.  Everything is
expressed with native Spark SQL expressions; Python crosses the JVM boundary
only for the syntax check of generated code, user-supplied inference clients,
pluggable tokenizers and streaming state.
"""

from drover.session import get_session, shared_path

__all__ = ["get_session", "shared_path"]
