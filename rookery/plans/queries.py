"""All queries over the test tables; importing the modules registers them."""

from __future__ import annotations

from rookery.plans import experiments, files, nets, positions, records, streams  # noqa: F401
from rookery.plans.registry import ORACLES, QUERIES  # noqa: F401
