"""Errors of the record engine."""


class RecordError(Exception):
    """Base of all errors that the engine raises by itself."""


class MissingDataset(RecordError):
    """An operation needs a dataset and none was given."""


class NonUniqueKey(RecordError):
    """A delete named a value that several rows hold."""


class MissingEngine(RecordError):
    """The facade was built without the engine that an operation needs."""


class BadOption(RecordError):
    """An option is not allowed where it was given."""
