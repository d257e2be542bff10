"""What can go wrong when a query is built or a change is applied."""


class BuildError(ValueError):
    """A query that cannot be built; raised before any Spark job."""


class UnknownTable(BuildError):
    """The query names a table that isn't registered."""


class UnknownColumn(BuildError):
    """The query names a column that its table hasn't."""


class UnknownRelationship(BuildError):
    """The query names a relationship that it hasn't."""


class Invalid(BuildError):
    """The query contradicts itself."""


class Unsupported(BuildError):
    """The query asks for what the language leaves out."""


class SchemaViolation(ValueError):
    """Rows don't fit their table's columns."""


class ConsistencyViolation(ValueError):
    """A change adds a key that exists, or removes or edits one that doesn't."""


class SumOverflow(ArithmeticError):
    """An integer sum that 64 bits can't hold."""


class DeadlineExceeded(TimeoutError):
    """Applying a batch took longer than it may."""
