"""Error codes and bounded error text."""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from itertools import accumulate


class RetrievalError(Exception):
    def __init__(self, code: str, message: str, next_step: str = ""):
        super().__init__(message)
        self.code = code
        self.next_step = next_step


# Codes and the message patterns they stand for, tried in this order. The advice is our own.
_RULES = [
    (r"max_file_bytes", "SOURCE_LIMIT", "Leave the large file out, or raise max_file_bytes"),
    (r"max_context_chars", "CONTEXT_BUDGET", "Ask less at once, or raise max_context_chars"),
    (r"not configured", "CONFIG_REQUIRED", "Name the collections and an embedding provider first"),
    (r"key missing", "MODEL_KEY_MISSING", "Export the provider's API key"),
    (r"busy|locked", "BUSY", "Another writer is active; try later"),
    (r"cancel", "CANCELLED", "Start again if you still want it"),
    (r"timed? ?out|timeout", "TIMEOUT", "Try again with a longer timeout"),
    (r"embedding|fetch|http|model", "MODEL_UNAVAILABLE", "See whether the provider answers and its settings are right"),
    (r"run sync|not synchronized|no such table|unable to open database", "INDEX_REQUIRED", "Build the index: run sync"),
]
_FALLBACK = ("INVALID_REQUEST", "Compare the request and the options with the documentation")


def classify(error: object) -> tuple[str, str]:
    """(code, next step) for an exception or message."""
    if isinstance(error, RetrievalError):
        return error.code, error.next_step
    message = str(error)
    for pattern, code, advice in _RULES:
        if re.search(pattern, message, re.IGNORECASE):
            return code, advice
    return _FALLBACK


def utf16_units(text: str) -> int:
    return len(text.encode("utf-16-le", "surrogatepass")) // 2


def compact_json(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def bounded_error(error: object, limit: int = 256) -> str:
    """Error JSON of at most ``limit`` UTF-16 units, keeping the longest message prefix.

    Characters are escaped one by one in JSON, so each has a price of its own and the frame around them too.
    """
    code, advice = classify(error)
    document = {"status": "error", "code": code, "next": advice[:90], "error": ""}
    message = str(error)[:4096]
    prices = accumulate((utf16_units(compact_json(c)) - 2 for c in message), initial=utf16_units(compact_json(document)))
    document["error"] = message[: max(bisect_right(list(prices), limit) - 1, 0)]
    return compact_json(document)
