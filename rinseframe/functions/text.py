"""Text clean-up with built-in functions only, so that it stays inside generated code."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# The characters Python's str.strip() removes (Unicode white space and separators).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# ASCII punctuation that the punctuation step removes. The backslash stays.
PUNCTUATION_CLASS = r"""[!"#$%&'()*+,\-./:;<=>?@\[\]^_`{|}~]"""


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def is_padded(c: Column) -> Column:
    return c != strip(c)


def title_case(c: Column) -> Column:
    """A capital after every non-letter, lower case elsewhere (``initcap`` only looks at blanks)."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    cased = F.transform(
        runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 2147483647)))
    )
    return F.array_join(cased, "")


def remove_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, PUNCTUATION_CLASS, "")


SIMPLE_METHODS = {
    "lowercase": F.lower,
    "uppercase": F.upper,
    "titlecase": title_case,
    "remove_punctuation": remove_punctuation,
}


def java_pattern(pattern: str) -> str:
    """Named groups and their back references as Java spells them."""
    pattern = re.sub(r"\(\?P<(\w+)>", r"(?<\1>", pattern)
    return re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern)


def java_replacement(text: str) -> str:
    """A Python replacement template as Java spells it: ``\\1`` -> ``$1``, ``$`` -> ``\\$``."""

    def convert(match: re.Match) -> str:
        token = match.group(0)
        if token == "$":
            return r"\$"
        if match.group("num"):
            return "$" + match.group("num")
        if match.group("name"):
            name = match.group("name")
            return "$" + name if name.isdigit() else "${" + name + "}"
        return token

    return re.sub(r"\$|\\(?P<num>\d{1,2})|\\g<(?P<name>\w+)>|\\\\", convert, text)
