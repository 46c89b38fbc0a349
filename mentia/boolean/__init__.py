"""The Boolean query language: parsed on the driver, run as Catalyst expressions."""

from mentia.boolean.compile import matches, matching_queries
from mentia.boolean.many import matching_many
from mentia.boolean.language import BooleanQueryError, parse, render, validate

__all__ = ["BooleanQueryError", "matches", "matching_many", "matching_queries", "parse", "render", "validate"]
