"""Walks over parsed JSON, shared by the id search and the id-path report."""

from __future__ import annotations

import json
from collections.abc import Iterator


def parse(text):
    """The parsed value, or None for anything that is not JSON text."""
    try:
        return json.loads(text) if isinstance(text, str) else None
    except (ValueError, RecursionError):
        return None


def objects(node, depth: int, place: tuple = (), names: tuple = (), first_only: bool = False) -> Iterator[tuple]:
    """(place, names, object) of every object down to ``depth`` levels.

    ``place`` lists child positions from the root, so sorting by its length
    and then by itself goes level by level in document order.  ``names`` is
    the path, a list marked by ``[]`` after its name.
    """
    if len(place) > depth:
        return
    if isinstance(node, dict):
        yield place, names, node
        below = [(names + (str(k),), v) for k, v in node.items()]
    elif isinstance(node, list):
        own = names[:-1] + ((names[-1] if names else "") + "[]",)
        below = [(own, v) for v in (node[:1] if first_only else node)]
    else:
        return
    for i, (path, child) in enumerate(below):
        yield from objects(child, depth, place + (i,), path, first_only)


def identifier(value) -> str:
    """A string or whole number as stripped text, else the empty string."""
    plain = isinstance(value, (str, int)) and not isinstance(value, bool)
    return str(value).strip() if plain else ""


def nearest_identifier(text, ranks: dict[str, int], depth: int) -> str | None:
    """The identifier nearest to the root under a ranked key; among equals
    the first in document order, then the better key."""
    hits = ((len(place), place, ranks[key], identifier(obj[key]))
            for place, _, obj in objects(parse(text), depth) for key in ranks.keys() & obj.keys() if identifier(obj[key]))
    best = min(hits, default=None)
    return best[-1] if best else None
