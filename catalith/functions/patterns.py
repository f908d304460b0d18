"""Regular expressions for names and titles, put together from word lists and named parts."""

from __future__ import annotations

from collections.abc import Iterable

from catalith.functions import vocabulary as V

ANY_CASE, START, END, SPACE, GAP = "(?i)", "^", "$", r"\s+", r"\s*"


def one_of(words: Iterable[str]) -> str:
    """Any of the words, longer ones first; dots stand for themselves."""
    return "(?:" + "|".join(w.replace(".", r"\.") for w in sorted(words, key=lambda w: (-len(w), w))) + ")"


def digits(least: int, most: int) -> str:
    return rf"\d{{{least},{most}}}"


def charset(characters: str) -> str:
    return "[" + "".join("\\" + c if c in "\\]^-[" else c for c in characters) + "]"


def bracketed(inner: str) -> str:
    """In round or square brackets, with room at both ends."""
    return charset("([") + GAP + inner + GAP + charset(")]")


# A title's leading number, as rippers write it: disc and track with words, disc and
# track as numbers, a track number with mark and space, with a zero, with a mark.
_MARK, _MARKS = charset("-_."), charset("-_. ") + "+"
TRACK_PREFIXES = (
    ANY_CASE + START + GAP + one_of(V.DISC_WORDS) + GAP + r"\d+" + GAP + _MARKS + GAP + digits(1, 3) + GAP + _MARKS,
    START + GAP + digits(1, 2) + GAP + _MARK + GAP + digits(1, 3) + SPACE,
    START + GAP + digits(2, 3) + GAP + _MARK + SPACE,
    START + GAP + r"0\d" + SPACE,
    START + GAP + digits(2, 3) + charset("._") + GAP,
)


def _numeral(one: str, five: str = "", ten: str = "") -> str:
    """One decimal place of a Roman numeral; thousands have no five or ten and go up to four."""
    return f"(?:{one}{ten}|{one}{five}|{five}?{one}{{0,3}})" if ten else f"{one}{{0,4}}"


ROMAN_NUMERAL = START + "".join(_numeral(*letters) for letters in ("M", "CDM", "XLC", "IVX")) + END

# a credit ends the name: what follows the word, if anything, goes with it
_CREDIT = ANY_CASE + SPACE
GUEST_CREDIT = _CREDIT + one_of((*V.CREDIT_WORDS, "feat.", "special guest", "and friends")) + rf"(?:\s.*)?{END}"
FEATURE_CREDIT = _CREDIT + one_of((*V.CREDIT_WORDS, "feat", "feat.")) + SPACE + ".*" + END

# the three places of the article
LEADING_THE = ANY_CASE + START + GAP + "the" + SPACE
TRAILING_THE = ANY_CASE + "," + GAP + "the" + GAP + END
BRACKETED_THE = ANY_CASE + r"\(" + GAP + "the" + GAP + r"\)" + GAP + END

LIVE_MARKER = ANY_CASE + r"\b" + one_of(V.LIVE_WORDS) + r"\b"

_YEAR = one_of(("19", "20")) + digits(2, 2)
_VERSION = one_of(V.VERSION_WORDS)
QUALIFIERS = (
    ANY_CASE + bracketed(f"(?:{_YEAR}{SPACE})?" + _VERSION + r"[\s\d,./+-]*"),
    bracketed(_YEAR),
    bracketed(digits(1, 2)),
    ANY_CASE + r"\b" + _VERSION + r"\b",
)

FORBIDDEN_IN_NAMES = charset(V.FORBIDDEN_IN_NAMES)
UNSAFE_IN_VALUES = charset(V.FORBIDDEN_IN_NAMES)[:-1] + r"\x00-\x1f]"
