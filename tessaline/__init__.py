"""Relational analytics on Spark with exact decimals of up to 288 digits."""

from tessaline.functions.dialect import sql, translate
from tessaline.session import session

__all__ = ["session", "sql", "translate"]
