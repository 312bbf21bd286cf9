"""Errors that the library raises on the driver."""


class NormsliceError(Exception):
    """Base of all errors of this library."""


class NormError(NormsliceError):
    """A norm, view, rule or recipe is wrong, or does not fit the log."""


class LogSchemaError(NormsliceError):
    """An event log lacks a column, or a column holds what it must not."""


class NotScoredError(NormsliceError):
    """There is nothing scored to work on."""
