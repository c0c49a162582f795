"""All queries of the detection, trace and frame operators, by name, each with its SQL twin."""

from __future__ import annotations

from quillsift.plans import detection, frames, traces

QUERIES = {**detection.QUERIES, **traces.QUERIES, **frames.QUERIES}
ORACLES = {**detection.ORACLES, **traces.ORACLES, **frames.ORACLES}
