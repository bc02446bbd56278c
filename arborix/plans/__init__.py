"""Importing the package registers all queries."""

from . import audits, experiments, searches, selections, trajectories  # noqa: F401
