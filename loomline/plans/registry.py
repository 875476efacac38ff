"""All registered queries of the library's own operators."""

from . import codebase, extra, graph, history, more, parsers, retrieval, text, usage  # noqa: F401
from .catalog import ORACLES, QUERIES  # noqa: F401
