"""End-to-end plans and the query registry."""

from importlib import import_module

QUERY_MODULES = ("flow_queries", "score_queries", "text_queries", "incident_queries",
                 "model_queries")


def load_queries():
    """All registered queries by name."""
    for name in QUERY_MODULES:
        import_module(f"flowlens.plans.{name}")
    from flowlens.plans.registry import REGISTRY
    return REGISTRY
