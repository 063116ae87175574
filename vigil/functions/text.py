"""Text expressions: charset cascade, mask removal, punctuation, tokens.

All of them are built-in Spark expressions, so a document is processed
whole inside the JVM, whatever its length.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import col

# Fixed values that must equal the source's behaviour:
# the 32 ASCII punctuation marks (Python's string.punctuation), in order.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# The same marks as ranges of a pattern, which is looked up without an object for each character.
PUNCTUATION_PATTERN = "[!-/:-@\\[-`{-~]+"
# Masking pattern: optional ASCII white space, then a run of capital X.
# White space is spelled out as the byte-string class of the source
# (space, tab, newline, carriage return, form feed, vertical tab) so
# every engine reads the same class.
MASK_PATTERN = "[ \\t\\n\\r\\f\\x0B]*X+"


def decode_bytes(b) -> Column:
    """Bytes of unknown charset -> string.

    UTF-16LE when the bytes start with the FF FE mark, UTF-16BE with FE FF
    (the mark is kept, and an odd length falls through), else UTF-8 when
    the bytes are valid UTF-8, else Latin-1 (which never fails).
    """
    b = col(b)
    head = F.hex(F.substring(b, 1, 2))
    even = (F.length(b) % 2) == 0
    as_str = b.cast("string")
    return (
        F.when(b.isNull(), F.lit(None).cast("string"))
        .when((head == "FFFE") & even, F.decode(b, "UTF-16LE"))
        .when((head == "FEFF") & even, F.decode(b, "UTF-16BE"))
        .when(F.is_valid_utf8(as_str), F.decode(b, "UTF-8"))
        .otherwise(F.decode(b, "ISO-8859-1"))
    )


def remove_masks(t) -> Column:
    """Delete masking runs of capital X with the white space before them."""
    t = col(t)
    return F.when(F.contains(t, F.lit("X")), F.regexp_replace(t, MASK_PATTERN, "")).otherwise(t)


def remove_punctuation(t) -> Column:
    return F.regexp_replace(col(t), PUNCTUATION_PATTERN, "")


def tokens(t) -> Column:
    """Cleaned token array of one document.

    masks removed -> punctuation removed -> newlines trimmed at both ends
    -> split on one space -> empty tokens dropped -> lower-cased.
    Inner newlines stay inside tokens.
    """
    cleaned = remove_punctuation(remove_masks(t))
    # lower-cased as a whole: a space ends a word for the one letter whose lower case depends on its neighbours
    return F.array_remove(F.split(F.lower(F.btrim(cleaned, F.lit("\n"))), " "), "")
