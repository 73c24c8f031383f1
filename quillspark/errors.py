"""Errors with a stable context id."""


class EngineError(Exception):
    """A whole-operation failure; ``context`` is a dotted id such as ``normalize.utf8``."""

    def __init__(self, context: str, message: str):
        super().__init__(f"{context}: {message}")
        self.context, self.message = context, message
