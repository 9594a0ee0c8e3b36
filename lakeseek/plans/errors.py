"""Errors of discovery and of its configuration."""


class DiscoveryError(Exception):
    """Anything that ends a discovery run; without ``debug`` it leaves the query table as it is."""


class KeyNotFoundError(DiscoveryError):
    """No lake table holds any of the query's keys."""


class InvalidQueryColumnType(DiscoveryError):
    """A query column has a type that features can't have."""


class UserTableNotProcessed(DiscoveryError):
    """The query table isn't prepared: nulls, text features, or no key and target."""


class UserTableHasDuplicates(DiscoveryError):
    """The query table has repeated column names."""


class InvalidMatch(DiscoveryError):
    """A selected feature isn't in the index."""


class LinAlgError(DiscoveryError):
    """A system of equations is singular."""


class TableLocked(DiscoveryError):
    """Another update of the table is under way."""


class EmptyAugmentation(DiscoveryError):
    """Nothing was selected."""


class ConfigValidationError(ValueError):
    """A configuration breaks its rules."""
