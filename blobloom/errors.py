"""Errors a caller can meet, by what went wrong."""


class BlobloomError(Exception):
    """Base of all errors raised by this package."""


class BlobNotFound(BlobloomError, KeyError):
    def __init__(self, blob_id: int):
        super().__init__(f"no blob with id {blob_id}")


class PathNotFound(BlobloomError, FileNotFoundError):
    def __init__(self, path: str):
        super().__init__(f"no file at {path}")


class ModelNotFound(BlobloomError, KeyError):
    def __init__(self, name: object):
        super().__init__(f"no model state {name}")


class TargetNotFound(BlobloomError, KeyError):
    def __init__(self, path: str):
        super().__init__(f"no entry at {path}")


class InvalidOperation(BlobloomError):
    """Duplicates, dependants, directory/file conflicts, version mismatch, bad preconditions."""


class UnknownAlgorithm(BlobloomError, LookupError):
    """No codec of this name or number."""


class InvalidInput(BlobloomError, ValueError):
    """Malformed image or stream."""


class ValidationError(BlobloomError, ValueError):
    """Malformed path or argument."""
