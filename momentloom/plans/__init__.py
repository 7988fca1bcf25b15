"""Queries over the given tables, grouped by area."""

AREAS = ("timeline", "text", "source", "report", "ranking", "tracking", "streaming")


def load() -> None:
    """Import every area so that it registers its queries."""
    from importlib import import_module

    for area in AREAS:
        import_module(f"{__name__}.{area}_queries")
