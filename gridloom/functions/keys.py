"""Keys of entities, documents and relationships."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANKS = r"(?U)^[\s ﻿]+|[\s ﻿]+$"


def strip(c: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(c, _BLANKS, "")


def norm_key(c: Column) -> Column:
    """A key without outer blanks, in lower case; null when nothing is left."""
    k = F.lower(strip(c))
    return F.when(k != "", k)


def hex_key_int(k: Column) -> Column:
    """A key of 16 hexadecimal digits as an order-preserving signed bigint; null for any other key."""
    unsigned = F.conv(k, 16, 10).cast("decimal(20,0)")
    shifted = (unsigned - F.lit("9223372036854775808").cast("decimal(20,0)")).cast("bigint")
    return F.when(k.rlike("^[0-9a-f]{16}$"), shifted)


def entity_key(name: Column, kind: Column) -> Column:
    text = F.concat(F.upper(strip(F.coalesce(name, F.lit("")))), F.lit("|"), F.upper(strip(F.coalesce(kind, F.lit("")))))
    return F.substring(F.md5(F.encode(text, "UTF-8")), 1, 16)


def document_key(name: Column) -> Column:
    return F.substring(F.md5(F.encode(strip(name), "UTF-8")), 1, 16)


def relationship_key(src: Column, dst: Column, kind: Column) -> Column:
    text = F.concat(src, F.lit("|"), dst, F.lit("|"), F.upper(strip(kind)))
    return F.substring(F.md5(F.encode(text, "UTF-8")), 1, 16)
