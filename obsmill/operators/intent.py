"""Structured search intents: what a query must have said, edits, questions. One intent is one small object on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from decimal import Decimal

from obsmill.functions.numbers import mentions
from obsmill.operators.rank import Wants

# Words that name a budget's basis, sizes that a party word means.
BASIS_WORDS = {"per_night": r"\bشبی\b|هر ?شب|\bشبانه\b", "whole_stay": r"\bکل(?:ا|ش)?\b|\bمجموع|\bجمعا\b|\bروی ?هم\b"}
PARTY = {"solo": 1, "couple": 2}


@dataclass(frozen=True)
class Intent:
    nights: int | None = None
    guest_parts: tuple[int, ...] = ()
    party: str | None = None
    bedrooms_min: int | None = None
    budget_toman: int | None = None
    basis: str = "unknown"
    max_drive_hours: float | None = None
    dates: tuple | None = None
    places: tuple[str, ...] = ()
    features: tuple[str, ...] = ()
    unhandled: tuple[str, ...] = ()

    @property
    def guests(self) -> int | None:
        return sum(self.guest_parts) if self.guest_parts else PARTY.get(self.party or "")


def violations(intent: Intent, query: str) -> dict[str, list[str]]:
    """By field what the normalised query doesn't say: numbers not mentioned, places and wishes not verbatim."""
    said = set(mentions(query))
    numbers = {"nights": [intent.nights], "guest_parts": intent.guest_parts, "bedrooms_min": [intent.bedrooms_min], "budget_toman": [intent.budget_toman], "max_drive_hours": [intent.max_drive_hours]}
    out = {field: [str(v) for v in values if v is not None and Decimal(str(v)) not in said] for field, values in numbers.items()}
    for field in ("places", "unhandled"):
        out[field] = [x for x in getattr(intent, field) if not x or x not in query]
    return {field: found for field, found in out.items() if found}


def without_violations(intent: Intent, query: str) -> Intent:
    """Drops fields that break a rule; of places and wishes only those that do."""
    bad = violations(intent, query)
    keep = {f: tuple(x for x in getattr(intent, f) if x not in bad[f]) for f in ("places", "unhandled") if f in bad}
    return replace(intent, **keep, **{f: () if f == "guest_parts" else None for f in bad if f not in ("places", "unhandled")})


def stated_basis(intent: Intent, query: str) -> Intent:
    """The budget's basis only where the query names it."""
    named = intent.basis == "unknown" or re.search(BASIS_WORDS[intent.basis], query)
    return intent if named else replace(intent, basis="unknown")


def without(intent: Intent, drops: list[str]) -> Intent:
    """Without the named constraints: a field's name, ``place:x``, ``feature:y``; ``basis:z`` reads an unstated budget."""
    whole = {"dates": {"dates": None}, "nights": {"nights": None}, "guests": {"guest_parts": (), "party": None}, "bedrooms": {"bedrooms_min": None}, "budget": {"budget_toman": None}, "drive": {"max_drive_hours": None}}
    for drop in drops:
        kind, _, value = drop.partition(":")
        if drop in whole:
            intent = replace(intent, **whole[drop])
        elif kind in ("place", "feature"):
            field = f"{kind}s"
            intent = replace(intent, **{field: tuple(x for x in getattr(intent, field) if x != value)})
        elif kind == "basis" and value in BASIS_WORDS and intent.basis == "unknown" and intent.budget_toman is not None and "budget" not in drops:
            intent = replace(intent, basis=value)
    return intent


def missing(intent: Intent) -> list[str]:
    """What to ask for before offers can be priced."""
    return [name for name, known in (("dates", intent.dates), ("guests", intent.guests)) if not known]


def wants(intent: Intent, nights: int) -> Wants:
    drive = None if intent.max_drive_hours is None else intent.max_drive_hours * 60
    return Wants(nights, intent.guests, intent.bedrooms_min, intent.budget_toman, intent.basis, intent.features, drive)
