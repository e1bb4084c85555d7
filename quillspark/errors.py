"""Errors that callers can tell apart."""


class CatalogError(Exception):
    code = -32603


class ConfigError(CatalogError):
    code = -32602


class ValidationError(CatalogError):
    code = -32602


class ParseError(CatalogError):
    def __init__(self, stage: str, message: str, line: int | None = None):
        super().__init__(message)
        self.stage, self.message, self.line = stage, message, line


class LimitError(CatalogError):
    code = -32602

    def __init__(self, name: str, limit: int, actual: int | None = None):
        super().__init__(f"{name} exceeds its limit of {limit}" + (f" ({actual})" if actual is not None else ""))
        self.limit_name, self.limit_value, self.actual_value = name, limit, actual
        self.limit_code = f"LIMIT_EXCEEDED_{name.upper()}"


class NotFound(CatalogError):
    code = -32001

    def __init__(self, resource: str, hints: list[str] | None = None):
        self.resource, self.hints = resource, hints or []
        text = f"Not found: {resource}"
        if self.hints:
            text += "\nDid you mean:" + "".join(f"\n  - {h}" for h in self.hints)
        super().__init__(text)
