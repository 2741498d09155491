"""Typed errors; ``retryable`` tells whether running again may help."""


class EngineError(Exception):
    code = "engine"
    retryable = False


class SchemaError(EngineError):
    code = "schema"


class IntegrityError(EngineError):
    code = "integrity"


class LimitError(EngineError):
    code = "limit"


class CausalityError(EngineError):
    code = "causality"
