"""All core queries; importing this module registers them."""

from lexiscope.plans import agreement, learning, report, sampling, skewed, sources, streams, texts  # noqa: F401
from lexiscope.plans.registry import QUERIES, SQL  # noqa: F401
