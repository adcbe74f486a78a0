"""Errors of the engine."""


class OperationFailure(Exception):
    """A specification is wrong."""


class WriteError(Exception):
    """A write can't be carried out."""


class DuplicateKeyError(WriteError):
    """A unique key is taken."""


class CollectionInvalid(Exception):
    """The collection exists already, or its name is wrong."""


class InvalidOperation(Exception):
    """A call that is not allowed in this state."""

class BulkWriteError(WriteError):
    """Some writes of a list failed; `details` says which and what was done."""

    def __init__(self, details: dict):
        super().__init__("batch op errors occurred")
        self.details = details
