"""Named queries (Spark builders + DuckDB oracle texts) and fixture views."""

from drover.plans.registry import QUERIES, NamedQuery, register


def load_all() -> dict:
    """Import every query module so that all queries are registered."""
    from drover.plans import trajectory_queries  # noqa: F401
    for mod in ("curation_queries", "dataset_queries", "funnel_queries", "text_queries",
                "source_queries", "stream_queries", "flow_queries", "audit_queries"):
        try:
            __import__(f"drover.plans.{mod}")
        except ModuleNotFoundError as e:
            if e.name != f"drover.plans.{mod}":
                raise
    return QUERIES


__all__ = ["QUERIES", "NamedQuery", "register", "load_all"]
