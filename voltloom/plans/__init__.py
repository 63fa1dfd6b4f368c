"""Named queries over the given tables."""

from importlib import import_module
from pathlib import Path


def load_all() -> None:
    """Import every query module once; importing registers its queries."""
    for path in sorted(Path(__file__).parent.glob("q_*.py")):
        import_module(f"{__name__}.{path.stem}")
