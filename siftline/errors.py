"""What can go wrong, by kind."""


class SiftlineError(Exception):
    """Base of all."""


class ConfigError(SiftlineError):
    """A setting is missing or has no meaning."""


class CodebaseNotFound(SiftlineError):
    """No codebase has this id, name or path."""


class NotIndexed(SiftlineError):
    """The folder holds no collection."""


class BadQuery(SiftlineError):
    """An argument of a query has no meaning."""


class ModelUnavailable(SiftlineError):
    """The model of vectors cannot be used as asked."""


class UnreadableFile(SiftlineError):
    """A file cannot be read."""


class ManifestError(SiftlineError):
    """A manifest is not what it should be."""


class SessionNotFound(SiftlineError):
    """No session has this id."""
