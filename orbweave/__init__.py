"""Space-filling-curve keys, similarity markers and spherical cells on Spark."""

__version__ = "0.1.0"
