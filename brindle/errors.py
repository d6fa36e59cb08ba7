"""Errors of the engine, with a code, a status and what to do next."""

from __future__ import annotations


class EngineError(Exception):
    """Base of all; the envelope is what a caller over HTTP would get."""

    code, status, next_step = "internal", 500, "Try again; if it persists, look at the cause."

    def __init__(self, message: str, next_step: str | None = None):
        super().__init__(message)
        self.next_step = next_step or self.next_step

    def envelope(self) -> dict:
        return {"error": {"code": self.code, "message": str(self), "nextStep": self.next_step}}


class InvalidRequest(EngineError):
    code, status, next_step = "invalid_request", 400, "Correct the request's fields."


class Unauthorised(EngineError):
    code, status, next_step = "unauthorised", 401, "Give the token the engine was made with."


class MissingHook(EngineError):
    code, status, next_step = "missing_hook", 503, "Make the engine with the hook that this call needs."

    def __init__(self, *hooks: str):
        super().__init__(f"not configured: {', '.join(hooks)}")
        self.hooks = hooks


class ModelFailed(EngineError):
    code, status, next_step = "model_failed", 502, "Try again later."
