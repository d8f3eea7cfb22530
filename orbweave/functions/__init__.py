"""Column functions: curve indexes, embedding markers, hash keys and sphere cells."""

from orbweave.functions import cells, curve, lsh, markers, unsigned

__all__ = ["cells", "curve", "lsh", "markers", "unsigned"]
