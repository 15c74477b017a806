"""Errors, by the layer that raises them."""


class TesseraError(Exception):
    """Base of all errors of this package."""


class ConfigError(TesseraError, ValueError):
    """A parameter is out of its range."""


class VectorError(TesseraError, ValueError):
    """A vector cannot be used: wrong length, not finite, or without length."""


class DimensionMismatch(VectorError):
    def __init__(self, expected: int, got: int):
        super().__init__(f"expected {expected} components, got {got}")
        self.expected, self.got = expected, got


class NotFinite(VectorError):
    def __init__(self, key, index: int):
        super().__init__(f"vector {key}: component {index} is not finite")
        self.key, self.index = key, index


class ZeroNorm(VectorError):
    def __init__(self, key=None):
        super().__init__(f"vector {key}: its norm is zero or overflows")
        self.key = key


class StoreError(TesseraError):
    """A store cannot be read or changed."""


class Incompatible(StoreError):
    """Configuration, model or schema differ from the store's."""


class Corrupt(StoreError):
    """A manifest or segment fails its checks."""


class Locked(StoreError):
    """Another writer holds the store."""


class IngestError(TesseraError):
    """Files could not be ingested."""
