"""Text expressions shared by the operators (all JVM-side)."""
from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null becomes the empty string.

    ``lower`` equals this on ASCII texts (told by equal byte and character
    lengths) and is much faster than ``translate``, which the rest needs: there
    ``lower`` would change letters beyond A-Z too.
    """
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def word_array(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the A-Z-lowered text."""
    return F.array_remove(F.split(ascii_lower(text), NOT_WORD), "")


def token_array(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text as it is."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")
