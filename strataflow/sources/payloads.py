"""Payloads that are sent as text, and bytes of unknown encoding, as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Bytes that a payload may have.
MOST = 10 * 1024 * 1024


def payload(data: Column, most: int = MOST) -> Column:
    """The bytes of a base64 text; null where it is none or would be larger than allowed, which its length says before anything is decoded."""
    plain = F.regexp_replace(data, r"\s+", "")
    fits = F.length(plain) <= (most + 2) // 3 * 4
    return F.when(fits & (F.length(plain) % 4 == 0) & plain.rlike("^[A-Za-z0-9+/]*={0,2}$"), F.try_to_binary(plain, F.lit("base64")))


def decoded_text(content: Column) -> Column:
    """The text of bytes: by their byte-order mark, else as UTF-8, whose invalid bytes become replacement characters."""
    head = F.hex(F.substring(content, 1, 3))
    rest = lambda n: F.substring(content, n + 1, 2**31 - 1 - n)
    utf8 = lambda c: F.make_valid_utf8(c.cast("string"))
    return F.when(head.startswith("FEFF"), F.decode(rest(2), "UTF-16BE")).when(head.startswith("FFFE"), F.decode(rest(2), "UTF-16LE")).when(head == "EFBBBF", utf8(rest(3))).otherwise(utf8(content))


def refused_pdf(content: Column, most: int = MOST) -> Column:
    """Why a file isn't read as PDF, else null: no PDF header in its first kilobyte, too large, or encrypted."""
    text = F.decode(content, "ISO-8859-1")
    return F.when(F.octet_length(content) > most, "too large").when(~F.coalesce(F.contains(F.substring(text, 1, 1024), F.lit("%PDF-")), F.lit(False)), "no PDF").when(F.contains(text, F.lit("/Encrypt")), "encrypted")
