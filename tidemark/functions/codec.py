"""Typed rules as JSON, so that a stored configuration holds all that a run needs.

A rule is written as its class name and its fields. Only classes of ``rules`` are
read back; anything else in a stored document is an error, not code.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence

from tidemark.functions import rules as R

KINDS = {c.__name__: c for c in vars(R).values()
         if isinstance(c, type) and issubclass(c, (R.Rule, R.RowRule)) and c not in (R.Rule, R.RowRule)}


def _listed(value):
    return [_listed(v) for v in value] if isinstance(value, (tuple, list)) else value


def _frozen(value):
    return tuple(_frozen(v) for v in value) if isinstance(value, list) else value


def encode(rule: R.Rule | R.RowRule) -> dict:
    """``{"rule": "Mask", "target": …}``; fields at their default are left out."""
    out = {"rule": type(rule).__name__}
    for f in dataclasses.fields(rule):
        value = getattr(rule, f.name)
        if f.default is dataclasses.MISSING or value != f.default:
            out[f.name] = _listed(value)
    return out


def decode(document: dict) -> R.Rule | R.RowRule:
    given = dict(document)
    name = given.pop("rule", None)
    if name not in KINDS:
        raise ValueError(f"unknown rule {name!r}")
    known = {f.name for f in dataclasses.fields(KINDS[name])}
    if extra := set(given) - known:
        raise ValueError(f"{name} has no fields {sorted(extra)}")
    return KINDS[name](**{k: _frozen(v) for k, v in given.items()})


def decode_all(documents: Sequence[dict] | None) -> tuple:
    return tuple(decode(d) for d in documents or ())
