"""Words as the text operators compare them."""

from __future__ import annotations

import re
import unicodedata

DOT_ABOVE = "̇"

# Signs that belong to the number before which they stand.
SIGNS = "+-−±%"

_NUMBER_AWARE = re.compile(rf"(?:[^\W_]|[̀-ͯ]|(?<=\d)[^\w\s](?=\d)|[{re.escape(SIGNS)}](?=\d))+")
_PLAIN = re.compile(r"(?:[^\W_]|[̀-ͯ])+")


def fold(text: str) -> str:
    """``text`` without letter case; all forms of i, dotted or not, are one letter."""
    if text.isascii():
        return text.lower()
    folded = unicodedata.normalize("NFC", text).replace("İ", "i").replace("ı", "i").casefold()
    return folded.replace("i" + DOT_ABOVE, "i")


def number_aware_words(text: str) -> list[str]:
    """Words of the folded text without punctuation.

    A mark between two digits and a sign or % directly before a digit belong to the number.
    """
    return _NUMBER_AWARE.findall(fold(text))


def plain_words(text: str) -> list[str]:
    """Runs of letters and digits of the folded text; every mark separates words."""
    return _PLAIN.findall(fold(text))
