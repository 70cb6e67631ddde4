"""Column functions."""

from .sequence import *  # noqa: F403
