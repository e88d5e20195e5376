"""Complete analyses composed of operators."""

from tablescout.plans.explore import explore, explore_sources, write_exploration

__all__ = ["explore", "explore_sources", "write_exploration"]
