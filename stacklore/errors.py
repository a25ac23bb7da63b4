"""Errors of the library, one class for each kind."""


class LibraryError(Exception):
    """Base of all."""


class NotFound(LibraryError): ...


class Duplicate(LibraryError): ...


class Validation(LibraryError): ...


class Source(LibraryError): ...


class Config(LibraryError): ...


class Serialization(LibraryError): ...
