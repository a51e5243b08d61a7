"""Catalog modules register their queries on import."""

from importlib import import_module

MODULES = (
    "corpus",
    "search",
    "contracts",
    "citations",
    "revisions",
    "resumes",
    "workspaces",
    "pages",
    "scores",
    "streams",
)


def load() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
