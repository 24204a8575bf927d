"""What can go wrong, one class a kind."""

from __future__ import annotations


class EngineError(Exception):
    """The base of all errors that the engine raises itself."""


class InvalidArtifact(EngineError): ...


class InvalidTensor(EngineError): ...


class MissingTensor(EngineError): ...


class InvalidJson(EngineError): ...


class UnsupportedDType(EngineError): ...


class UnsupportedArchitecture(EngineError): ...


class AmbiguousArchitecture(EngineError): ...


class Unsupported(EngineError): ...


class MemoryLimitExceeded(EngineError): ...


class InvalidPlan(EngineError): ...


class ResumeMismatch(EngineError): ...


class OutputCorrupted(EngineError): ...


class UnsupportedVersion(EngineError): ...


class PathEscape(EngineError): ...


class AlreadyExists(EngineError): ...


class LockUnavailable(EngineError): ...
