"""Every registered query of the engine's own operators, with the SQL that an independent engine runs for it."""

from __future__ import annotations

from . import accounts, answering, corpora, loops, pipelines, prompting, samples, scores, series, stores, texts  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "score_summary"
