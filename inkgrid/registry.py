"""Every query of the core library by name, with its SQL counterpart where there is one."""

from inkgrid.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
