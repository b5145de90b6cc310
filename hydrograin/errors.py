"""Typed errors: a code, a message key for translation, and parameters."""

from __future__ import annotations

#: Error codes and the HTTP status that a service answers with.
CODES = ("AOI_TOO_LARGE", "NO_VALID_ORBIT_PAIR", "NO_POST_EVENT_SCENE", "CDSE_UNAVAILABLE", "OHSOME_UNAVAILABLE", "MODEL_LOW_CONFIDENCE", "S2_TOO_CLOUDY", "BUSY", "INTERNAL")
HTTP_STATUS = 400


class FloodError(Exception):
    def __init__(self, code: str, **params: object) -> None:
        if code not in CODES:
            raise ValueError(f"unknown error code {code}")
        super().__init__(code)
        self.code, self.params = code, params

    @property
    def message_key(self) -> str:
        return f"errors.{self.code.lower()}"

    def payload(self) -> dict:
        return {"error": {"code": self.code, "message_key": self.message_key, "params": self.params}}
