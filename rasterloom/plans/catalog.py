"""All registered queries of the signal operators."""

from rasterloom.plans import codecs, relations, scalar, transforms
from rasterloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "codecs", "relations", "scalar", "transforms"]
