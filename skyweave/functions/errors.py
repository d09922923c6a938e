"""Errors that queries raise."""


class MissingColumnError(ValueError):
    """A column that is not there."""


class UnitsError(ValueError):
    """Units that an operation cannot take."""


class UnitConversionError(UnitsError):
    """Units that cannot be converted into one another."""
