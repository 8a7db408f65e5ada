"""One query per operator on the given tables, with its SQL twin where there is one."""

from nomenlink.checks import learning, matching, records, register, reports, silver, streams, text  # noqa: F401
from nomenlink.checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
