"""The registered queries and the SQL each one is checked against."""

from catalog import conversations, costs, events, models, prompts, streams  # noqa: F401
from catalog.registry import ORACLES, QUERIES  # noqa: F401
