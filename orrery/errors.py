"""Errors by the stage that finds them; the text is what a user sees."""


class EngineError(Exception):
    pass


class ParseError(EngineError):
    def __init__(self, at: int, message: str):
        self.at, self.message = at, message
        super().__init__(f"parse error at byte {at}: {message}")


class PlanError(EngineError):
    """Names and types that don't fit, found before any row is read."""


class ExecError(EngineError):
    """Found while rows are read or written."""


class StorageError(EngineError):
    def __init__(self, message: str):
        super().__init__(f"storage error: invalid argument: {message}")
