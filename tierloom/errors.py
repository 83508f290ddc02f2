"""Errors of the library."""


class TierError(Exception):
    """Any error of this library."""


class IngestError(TierError):
    """Input that can't be read."""


class StoreError(TierError):
    """A store that can't be opened, written or searched."""


class AuditError(TierError):
    """An audit that can't be run."""
