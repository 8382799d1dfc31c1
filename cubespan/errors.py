"""What can go wrong. Parameter errors are raised when a plan is made; data errors turn into null results."""


class CubeError(ValueError):
    """Of a cube or an estimator."""


class DimensionMismatch(CubeError):
    """Lengths differ, or the times carry no information."""


class BandOutOfRange(CubeError):
    def __init__(self, band: object, bands: int) -> None:
        super().__init__(f"band {band!r} is not one of the {bands} bands")


class InsufficientData(CubeError):
    def __init__(self, needed: int, got: int) -> None:
        super().__init__(f"needed {needed} observations, got {got}")
        self.needed, self.got = needed, got


class InvalidChunkSize(CubeError):
    """A tile has no rows or columns."""


class InvalidParameter(CubeError):
    """A parameter lies outside of what it may be."""


class SingularSystem(CubeError):
    """The regressors are collinear: an aliased harmonic or constant time."""


class StackError(RuntimeError):
    """Of a stack of scenes."""


class ConfigError(StackError):
    """Assets, box or dates don't make sense."""


class EmptyStack(StackError):
    """No scene is left."""


class ReprojectError(StackError):
    """A scene's grid can't be brought to the reference grid."""
