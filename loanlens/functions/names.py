"""Column-name rules, for driver-side names and for columns of names."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SAFE_NAME = r"^[a-zA-Z0-9_]+$"


def normalize_name(name: str) -> str:
    """Lower case; blank, dash and dot become an underscore."""
    return re.sub(r"[ .\-]", "_", name.lower())


def normalized(name: Column) -> Column:
    """``normalize_name`` for a column of header names."""
    return F.translate(F.lower(name), " -.", "___")


# The characters a header may differ in, for the plain and for the tiered match.
PLAIN_FILLER = "[_ ]"
TIERED_FILLER = r"[_\s-]"


def compact(name: Column, filler: str = TIERED_FILLER) -> Column:
    """Lower case without filler characters; basis of header matching."""
    return F.regexp_replace(F.lower(name), filler, "")


def compact_name(name: str, filler: str = TIERED_FILLER) -> str:
    return re.sub(filler, "", name.lower())


def check_name(name: str) -> str:
    if not re.fullmatch(SAFE_NAME.strip("^$"), name):
        raise ValueError(f"invalid column name: {name!r}")
    return name


def quoted(name: str) -> Column:
    """The column of exactly this name, whatever dots or backticks it holds."""
    return F.col(quote(name))


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
