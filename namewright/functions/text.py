"""Text expressions for noisy lines: normalising, cleaning and the guards of the accept rule.

All are JVM-side column expressions but for the Unicode decomposition of ``normalize``, which Spark has no function for and
which runs as an Arrow-batched UDF.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed values of the cleaning rule: characters that a line may trail off in.
TRAILING_JUNK = r"{}()[]0-9@#*%&+=|\/"
_JUNK_END = r"(?U)[{}()\[\]0-9@#*%&+=|\\/\s]+\z"
#: Fixed value of the decoy guard.
DECOY_KEYS = ("prosperity",)
FRAGMENT_LETTERS = 5
MIN_AUTO_CHARS = 3
MANA_TOKEN = r"(?s)^(.*\S)\s+([0-9XWUBRGC{}]{2,})$"


def decompose(text: str | None) -> str | None:
    """Compatibility decomposition without marks of a non-zero combining class."""
    if text is None or text.isascii():
        return text
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


@F.pandas_udf(StringType())
def _decomposed(text: pd.Series) -> pd.Series:
    return text.map(decompose, na_action="ignore")


def separated(text: Column) -> Column:
    """Lower case, with each run of other characters than a-z and 0-9 as one space and none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " "))


def normalize(text: Column) -> Column:
    """The key of a line. Characters that do not decompose, such as the letter ae, act as separators."""
    return separated(_decomposed(text))


def normalize_key(text: str) -> str:
    """``normalize`` of one Python string."""
    low = (decompose(text) or "").lower()
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in low).split())


def has_letter(text: Column) -> Column:
    return text.rlike(r"\p{IsAlphabetic}")


def clean(text: Column) -> Column:
    """The line up to its last token with a letter, white space collapsed, less what it trails off in."""
    upto = F.regexp_extract(text, r"(?sU)^(.*\p{IsAlphabetic}\S*)", 1)
    single = F.trim(F.regexp_replace(upto, r"(?U)\s+", " "))
    return F.trim(F.regexp_replace(single, _JUNK_END, ""))


def strip_mana_token(text: Column) -> Column:
    """The line without a last token that reads as a cost (two or more signs, a digit among them or all upper case), else null."""
    line = F.regexp_replace(text, r"(?U)\s+\z", "")
    token, head = F.regexp_extract(line, MANA_TOKEN, 2), F.regexp_extract(line, MANA_TOKEN, 1)
    cost = (token != "") & (token.rlike("[0-9]") | token.rlike("^[A-Z]+$"))
    return F.when(cost & (F.trim(head) != ""), head)


def starts_upper(text: Column) -> Column:
    return F.trim(text).rlike(r"^\p{Lu}")


def title_case_start(text: Column) -> Column:
    return starts_upper(text) & text.rlike(r"\p{Ll}")


def looks_like_name(text: Column) -> Column:
    """Starts upper case, has lower case, and no lower-case letter runs into an upper-case one."""
    return title_case_start(text) & ~text.rlike(r"\p{Ll}\p{Lu}")


def squashed(key: Column) -> Column:
    return F.replace(key, F.lit(" "), F.lit(""))


def equal_ignoring_spaces(one: Column, other: Column) -> Column:
    return squashed(one) == squashed(other)


def decoy_or_fragment(text: Column, best_key: Column) -> Column:
    """All letters upper case, and either few of them or a best key that is a known decoy."""
    letters = F.length(F.regexp_replace(text, r"[^\p{IsAlphabetic}]+", ""))
    return (letters > 0) & ~text.rlike(r"\p{Ll}") & ((letters < FRAGMENT_LETTERS) | best_key.isin(*DECOY_KEYS))


def too_short_for_auto(key: Column) -> Column:
    return F.length(squashed(key)) < MIN_AUTO_CHARS
