"""Names of elements and keys as column names."""

from __future__ import annotations

import re


def snake(name: str) -> str:
    """A canonical key as a column name: an underscore before every capital but the first."""
    return re.sub(r"(?<!^)(?=[A-Z])", "_", name).lower()


def xml_snake(name: str) -> str:
    """An XML name in snake case; a run of capitals is one word."""
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name).lower()
