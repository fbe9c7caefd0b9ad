"""Every query of the library by name, and its SQL."""

from .queries import QUERIES  # noqa: F401
from .oracle import ORACLE_SQL  # noqa: F401
