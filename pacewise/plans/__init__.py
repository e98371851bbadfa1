"""Registered queries."""

from . import access, groups, more, reports, space  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
