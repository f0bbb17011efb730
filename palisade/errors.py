"""One exception with a stable code, so callers can tell refusals apart."""

from __future__ import annotations


class EngineError(Exception):
    """code is machine-readable; the text never holds values of rows."""

    def __init__(self, code: str, text: str = "", hint: str | None = None):
        super().__init__(f"{code}: {text}" if text else code)
        self.code, self.text, self.hint = code, text, hint
