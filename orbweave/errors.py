"""Named errors of keys, markers, cells and their parameters."""


class EngineError(ValueError):
    """Base of all errors of this library; ``str`` starts with the error's name."""

    def __init__(self, detail: str = ""):
        super().__init__(f"{type(self).__name__}: {detail}" if detail else type(self).__name__)


class OrderOutOfRange(EngineError): ...


class CoordinateOutOfRange(EngineError): ...


class IndexOutOfRange(EngineError): ...


class DimensionsOutOfRange(EngineError): ...


class DimensionMismatch(EngineError): ...


class ZeroVector(EngineError): ...


class NonFiniteValue(EngineError): ...


class InvalidMarker(EngineError): ...


class OutputLengthMismatch(EngineError): ...


class BitsOutOfRange(EngineError): ...


class TablesOutOfRange(EngineError): ...


class LevelOutOfRange(EngineError): ...


class InvalidCell(EngineError): ...


class LatitudeOutOfRange(EngineError): ...


class NonFinite(EngineError): ...


class RadiusOutOfRange(EngineError): ...


class BufferTooSmall(EngineError): ...


class CoverOptionsOutOfRange(EngineError): ...


class RegionOutOfRange(EngineError): ...


class CoverTooLarge(EngineError): ...
