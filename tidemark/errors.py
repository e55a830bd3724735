"""Errors that a user can act on."""


class TidemarkError(Exception):
    """Base of all errors raised on purpose."""


class ConfigError(TidemarkError):
    """The specification is wrong or contradicts itself."""


class DataError(TidemarkError):
    """The data do not have what the specification says."""


class LeakageError(TidemarkError):
    """A blocking finding under the `fail` policy, or nothing left after quarantine."""


class InsufficientDataError(TidemarkError):
    """Too little history, too few rows or too few events to go on."""
