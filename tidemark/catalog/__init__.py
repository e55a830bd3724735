"""One query per operator over the driver's tables, with the SQL that gives the same rows."""

from . import cleaning, features, inference, panel, scoring

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _module in (panel, features, scoring, inference, cleaning):
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE
