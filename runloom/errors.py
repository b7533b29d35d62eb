"""Exceptions of the array API."""


class RunloomError(Exception):
    """Base of all."""


class InvariantViolation(RunloomError):
    """Runs that don't cover their domain exactly once."""


class InvalidTensor(RunloomError):
    """A shape or dtype that can't be."""


class IncompatibleTensor(RunloomError):
    """Operands whose shapes or dtypes don't fit together."""


class UnimplementedOperation(RunloomError):
    """An operation that the dtype doesn't have."""


class TypeConversion(RunloomError):
    """A value that can't become the dtype."""
