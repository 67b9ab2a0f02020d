from quire.functions import names, sqltext, text, types

__all__ = ["names", "sqltext", "text", "types"]
