"""Imports every module that registers queries."""

from trackmill.plans import events, files, identity, labels, models, ops, people, selection, sources, streams, tracks  # noqa: F401
