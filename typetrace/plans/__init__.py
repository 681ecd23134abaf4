"""Registered queries by area; importing this package fills the registry."""

from typetrace.plans.registry import REGISTRY
from typetrace.plans import auto, catalog, expressions, images, lines, matching, pixels, streams  # noqa: F401

__all__ = ["REGISTRY"]
