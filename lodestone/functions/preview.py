"""Text budgets inside a JSON response, for one request at a time (at most 100 results)."""

from __future__ import annotations

import re

import numpy as np

from ..errors import utf16_units

_TWO = re.compile(r'["\\\b\t\n\f\r]')
_SIX = re.compile(r"[\x00-\x07\x0b\x0e-\x1f\ud800-\udfff]")


def escaped_cost(text: str) -> int:
    """UTF-16 length of the text within a JSON string literal."""
    return utf16_units(text) + len(_TWO.findall(text)) + 5 * len(_SIX.findall(text))


def text_budgets(costs: list[int], budget: int) -> list[int]:
    """Equal shares of the budget; texts that need less return the rest to the others.

    Served from the cheapest up, so each unmet share only grows; what does not divide evenly
    goes to the earliest of the texts that are cut.
    """
    granted = [0] * len(costs)
    waiting = sorted(range(len(costs)), key=lambda i: costs[i])
    left = budget
    while waiting and costs[waiting[0]] <= left // len(waiting):
        i = waiting.pop(0)
        granted[i] = costs[i]
        left -= costs[i]
    if waiting:
        share, extra = divmod(left, len(waiting))
        for order, i in enumerate(sorted(waiting)):
            granted[i] = share + (order < extra)
    return granted


def text_prefix(text: str, budget: int) -> str:
    """Longest prefix of whole code points whose escaped cost fits the budget."""
    head = text[: max(budget, 0)]  # every code point costs at least one
    codes = np.frombuffer(head.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    cost = np.where(codes > 0xFFFF, 2, 1)
    cost[np.isin(codes, [8, 9, 10, 12, 13, 34, 92])] = 2
    cost[(codes < 32) & ~np.isin(codes, [8, 9, 10, 12, 13])] = 6
    cost[(codes >= 0xD800) & (codes <= 0xDFFF)] = 6
    return head[: int(np.searchsorted(np.cumsum(cost), budget, side="right"))]


def preview_range(start_line: int, text: str) -> dict[str, int]:
    """1-based lines and UTF-16 columns of a text; the end column is exclusive."""
    return {
        "start_line": start_line, "start_column": 1, "end_line": start_line + text.count("\n"),
        "end_column": utf16_units(text.rpartition("\n")[2]) + 1,
    }
