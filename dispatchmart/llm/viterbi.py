"""Cheapest edits that turn a sequence of roles into ``(s?(ua)+)?``, by backward costs.

A row is a letter of a small alphabet: the class of its role and its fault. Costs to the end from each of four
states (nothing yet, after s, after u, after a) form a vector. Only its differences decide what is cheapest, so a vector is
kept with its least entry at zero, beside the sum of what was taken off; two vectors that differ by a constant are then
one and the same. Few such vectors exist, and what a row does to one is remembered.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache
from typing import NamedTuple

DELETE, RENAME, INSERT, TRUNCATED_STAYS = 3, 2, 2, 1

NO_FAULT, TRUNCATED, BLANK, DUPLICATE = range(4)
CLASSES = "sua"
"""First letters of a role that the pattern knows; any other role is of class 3."""
ABSENT = 16
"""A row that only names its conversation."""

ROLE_NAMES = {2: "user", 3: "assistant"}
_AFTER = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}  # state, class of the row: next state
_FILLED = (2, 2, 3, 2)  # the state after the one role that the pattern allows to be put in
_ENDS = (0, 3)
_NEVER = 1 << 30

Costs = tuple[int, int, int, int]


def code_of(role_class: int, fault: int) -> int:
    return role_class + 4 * fault


def _with_insertions(costs: list[int]) -> Costs:
    for _ in costs:
        costs = [min(cost, INSERT + costs[_FILLED[state]]) for state, cost in enumerate(costs)]
    return tuple(costs)


FINAL = _with_insertions([0 if state in _ENDS else _NEVER for state in range(4)])


def _choices(state: int, code: int, after: Costs) -> dict[str, int]:
    """What each edit of the row costs from here to the end, the edit itself included."""
    role_class, fault = code % 4, code // 4
    costs = {"D": DELETE + after[state]}
    if fault in (NO_FAULT, TRUNCATED):
        stays = TRUNCATED_STAYS if fault == TRUNCATED else 0
        costs["R"] = RENAME + stays + after[_FILLED[state]]
        if (state, role_class) in _AFTER:
            costs["K"] = stays + after[_AFTER[state, role_class]]
    return costs


@lru_cache(maxsize=None)
def before(code: int, after: Costs) -> tuple[Costs, int]:
    """The costs before a row from those after it, least entry at zero, and what was taken off."""
    if code == ABSENT:
        return after, 0
    costs = _with_insertions([min(_choices(state, code, after).values()) for state in range(4)])
    return tuple(cost - min(costs) for cost in costs), min(costs)


class Step(NamedTuple):
    """What becomes of one row."""

    audit: str
    inserted: tuple[str, ...]
    stays: bool
    role: str | None
    """The new role, None if the old one stays."""
    state: int


@lru_cache(maxsize=None)
def step(state: int, code: int, after: Costs) -> Step:
    """The edits of a row, and of roles put in before it, that keep to the cheapest cost with the least letters."""
    if code == ABSENT:
        return Step("", (), False, None, state)
    costs, off = before(code, after)
    audit, inserted = "", []
    while True:
        choices = _choices(state, code, after) | {"I": INSERT + off + costs[_FILLED[state]]}
        edit = min(e for e, cost in choices.items() if cost == off + costs[state])
        audit += edit
        if edit == "D":
            return Step(audit, tuple(inserted), False, None, state)
        if edit == "K":
            return Step(audit, tuple(inserted), True, None, _AFTER[state, code % 4])
        state = _FILLED[state]
        if edit == "R":
            return Step(audit, tuple(inserted), True, ROLE_NAMES[state], state)
        inserted.append(ROLE_NAMES[state])


def ending(state: int) -> list[str]:
    """Roles put in after the last row."""
    roles = []
    while state not in _ENDS:
        state = _FILLED[state]
        roles.append(ROLE_NAMES[state])
    return roles


def backward(codes: bytes, end: Costs) -> tuple[list[Costs], Costs, int]:
    """For each row the costs after it; the costs before the first row; the sum taken off."""
    after, total, now = [end] * len(codes), 0, end
    for i in range(len(codes) - 1, -1, -1):
        after[i] = now
        now, off = before(codes[i], now)
        total += off
    return after, now, total


def rerun(codes: bytes, old: Costs, new: Costs) -> tuple[Costs | None, int]:
    """Run again from another end, until the costs differ from the old ones by a constant only.

    Gives the costs before the first row, or None if they are the old ones, and by how much the sum taken off grows.
    """
    grown = 0
    for code in reversed(codes):
        if old == new:
            return None, grown
        old, old_off = before(code, old)
        new, new_off = before(code, new)
        grown += new_off - old_off
    return (None if old == new else new), grown


def trace(codes: bytes, after: list[Costs], state: int) -> list[Step]:
    """The steps of a stretch that is entered in ``state``."""
    steps = []
    for code, costs in zip(codes, after):
        steps.append(step(state, code, costs))
        state = steps[-1].state
    return steps


def bad_neighbours(codes: Iterable[int], last: int | None = None) -> tuple[int, int | None]:
    """Adjacent rows whose roles do not follow each other, after a row of class ``last``; the class of the last row."""
    bad = 0
    for code in codes:
        if code != ABSENT:
            bad += last is not None and (last, code % 4) not in ((0, 1), (1, 2), (2, 1))
            last = code % 4
    return bad, last
