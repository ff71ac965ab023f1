"""Text expressions: message search patterns, cursor text, number printing."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SEARCH_MODES = ("wildcard", "literal")


def search_pattern(q: str, mode: str = "wildcard") -> str:
    """Pattern for a case-insensitive LIKE that finds ``q`` anywhere.

    ``wildcard`` passes ``%`` and ``_`` through as wildcards; a backslash escapes ``%``, ``_`` and
    itself and otherwise stands for itself. ``literal`` takes every character as written.
    """
    if mode not in SEARCH_MODES:
        raise ValueError(f"unknown search mode: {mode}")
    if mode == "literal":
        return "%" + re.sub(r"([\\%_])", r"\\\1", q) + "%"
    # LIKE refuses a backslash before an ordinary character, so that one is doubled.
    return re.sub(r"\\([%_\\])|\\", lambda m: m.group(0) if m.group(1) else r"\\", f"%{q}%")


def contains_text(column: Column, q: str, mode: str = "wildcard") -> Column:
    return column.ilike(search_pattern(q, mode))


def cursor_text(timestamp_text: Column, id_: Column) -> Column:
    """base64url of the JSON object {timestamp, id}, without padding."""
    payload = F.to_json(F.struct(timestamp_text.alias("timestamp"), id_.alias("id")))
    encoded = F.base64(F.encode(payload, "utf-8"))
    # Spark's base64 may wrap lines; none of these characters belongs to the url alphabet.
    return F.translate(F.translate(encoded, "+/", "-_"), "=\r\n", "")


def number_text(number: str) -> str:
    """SQL for a DOUBLE as JavaScript prints it: plain digits from 1e-6 to 1e21, else an exponent."""
    java = f"CAST({number} AS STRING)"
    mantissa, exponent = f"split_part({java}, 'E', 1)", f"CAST(split_part({java}, 'E', 2) AS INT)"
    # The significant digits of "d.ddd": no sign, no point, no fraction of zero.
    digits = f"translate(regexp_replace({mantissa}, r'\\.0\\z', ''), '-.', '')"
    sign = f"CASE WHEN {number} < 0 THEN '-' ELSE '' END"
    return f"""
      CASE WHEN {number} = 0 THEN '0'
           WHEN NOT contains({java}, 'E') THEN regexp_replace({java}, r'\\.0\\z', '')
           WHEN {exponent} BETWEEN 0 AND 20 AND length({digits}) <= {exponent} + 1
             THEN {sign} || rpad({digits}, {exponent} + 1, '0')
           WHEN {exponent} BETWEEN 0 AND 20
             THEN {sign} || left({digits}, {exponent} + 1) || '.'
                  || substr({digits}, {exponent} + 2)
           WHEN {exponent} BETWEEN -6 AND -1
             THEN {sign} || '0.' || repeat('0', -{exponent} - 1) || {digits}
           ELSE {sign} || left({digits}, 1)
                || CASE WHEN length({digits}) > 1 THEN '.' || substr({digits}, 2) ELSE '' END
                || CASE WHEN {exponent} > 0 THEN 'e+' ELSE 'e' END
                || CAST({exponent} AS STRING) END"""
