"""All registered queries."""

from . import features, judging, loading, modelling  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
