"""Named queries of the library; importing the modules registers them."""
from recollect.plans import continual, fuller, learning, loading, memory, more, neighbours, network, related, search, statistics, summaries, surface
from recollect.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "continual", "fuller", "learning", "loading", "memory", "more", "neighbours", "network", "related", "search", "statistics", "summaries", "surface"]
