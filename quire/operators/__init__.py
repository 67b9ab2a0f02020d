from quire.operators import chunks, clean, combine, labels, sections, typing

__all__ = ["chunks", "clean", "combine", "labels", "sections", "typing"]
