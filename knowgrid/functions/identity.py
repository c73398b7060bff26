"""Keys of people: address normalisation as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the host where the part after "+" is the login and is kept.
NOREPLY_HOST = "users.noreply.forgehub.example"


def normalize_email(c: Column, noreply_host: str = NOREPLY_HOST) -> Column:
    """Trimmed, lower-cased address without display name and without ``+tag``.

    ``Name <a+x@b>`` gives ``a@b``; at the no-reply host the tag stays, since it carries the login.
    NULL stays NULL; text without ``@`` is only trimmed and lower-cased.
    """
    inner = F.regexp_extract(c, r"<([^<>]*)>", 1)
    addr = F.lower(F.trim(F.regexp_replace(F.when(inner != "", inner).otherwise(c), r"^[\s ]+|[\s ]+$", "")))
    return F.when(addr.endswith("@" + noreply_host), addr).otherwise(F.regexp_replace(addr, r"^([^@+]+)\+[^@]*@", "$1@"))


def email_domain(c: Column) -> Column:
    """Part after the last ``@``; empty without one."""
    return F.when(c.contains("@"), F.substring_index(c, "@", -1)).otherwise(F.lit(""))
