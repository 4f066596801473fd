r"""Patterns written once, with the meaning that \b and \s have for ECMAScript, for Java (Spark) and RE2 (DuckDB).

\b is a boundary of [A-Za-z0-9_] and \s includes the Unicode spaces, which neither engine does by itself.
"""

from __future__ import annotations

import re

SPACES = r"\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
_WORD = "[A-Za-z0-9_]"
_BOUNDARY = f"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))"


def _spaces(pattern: str) -> str:
    out, inside, k = [], False, 0
    while k < len(pattern):
        two = pattern[k : k + 2]
        if two == r"\s":
            out.append(SPACES if inside else f"[{SPACES}]")
            k += 2
            continue
        if two.startswith("\\"):
            out.append(two)
            k += 2
            continue
        inside = (pattern[k] == "[") or (inside and pattern[k] != "]")
        out.append(pattern[k])
        k += 1
    return "".join(out)


def java(pattern: str, collapsed: bool = False) -> str:
    r"""For Spark. collapsed: the text has no space but single U+0020, so that \s is that.

    A boundary before a letter is tested after it and one after a word by looking ahead: a pattern that begins with its
    letter fails at once at almost every place of a text.
    """
    out = pattern.replace(r"\s", " ") if collapsed else _spaces(pattern)
    out = re.sub(r"\\b([A-Za-z])", lambda m: f"{m[1]}(?<!{_WORD}{m[1]})", out)
    out = out.replace(r"\b(", f"(?<!{_WORD})(")
    out = re.sub(r"(?<=[A-Za-z)])\\b", f"(?!{_WORD})", out)
    return out.replace(r"\b", _BOUNDARY)


#: Runs of spaces that are not a single U+0020 already.
UNEVEN = rf"(?:[{SPACES.replace(' ', '')}]| (?=[{SPACES}]))[{SPACES}]*"


def re2(pattern: str) -> str:
    return _spaces(pattern)


# The repairs of recognised prose in their order, (pattern, replacement with $n).
REPAIRS = (
    (r"(?i)\bocial\b", "social"),
    (r"\bBut[Il]n\b", "But In"),
    (r"(?i)\bwor[’']([\s.,!?]|$)", "work$1"),
    (r"(?i)\bphon[!1]e\b", "phone"),
    (r"(?i)\bcortiso\b", "cortisol"),
    (r"(?i)\bi[.)]\s+Soon\b", "Soon"),
    (r"(?i)\bi\s+Soon\b", "Soon"),
    (r"(?i)\bSoon\s+your\b", "Soon your"),
    (r"\s+([,.;:!?%…])", "$1"),
    (r"([(\[{“‘«])\s+", "$1"),
    (r"\s{2,}", " "),
)

# Single patterns.
ZERO_WIDTH = r"[\x{200B}-\x{200D}\x{FEFF}]"
DASHES = r"[‐‑‒–—]"
CONTROLS = r"[\x{0}-\x{8}\x{B}\x{C}\x{E}-\x{1F}\x{7F}-\x{9F}]"
NAME_FORMATTING = r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{FEFF}]"
PUNCTUATION_ONLY = r"^[.,;:!?…'”’\")}\]»]+$"
CLOSERS = r"^[.,;:!?%…”’)}\]»]+$"
OPENERS = r"^[({\[“‘«]+$"
LAYOUT_CLOSERS = r"^[,.;:!?%…)}\]»]+$"
LIST_MARKER = r"^(?:[-•‣◦]|[0-9]{1,3}[.)])$"
ONE_ALNUM = r"^[\p{L}\p{N}]$"
ONE_LETTER_WORD = r"^(?:a|A|I)$"
BARS_ONLY = r"^[©|:;]+$"
BROKEN_LETTERS = r"\p{L}[!|]\p{L}"
JOINED_SENTENCE = r"[.!?][A-Z][a-z]"
MALFORMED = r"(?i)\b(?:pu|casy)\b"
LONE_MARK = r"(?:^|\s)[©|:;0-9](?:\s|$)"
LATER_NOISE = r"(?i)^[:;,.\-–—]?\s*[©CP8wyPi:]{1,12}\s*(?:er|or)\s+later[,.:]?$"
LATER_FRAGMENT = r"(?i)^[:;,.\-–—\s©CP8wyPi]+er\s+or\s+later[,.:]?$"
LATER_SUFFIX = r"(?i)er\s+or\s+later[,.:]?$"
ENDS_WITH_SO = r"(?i)\.\s*So$"
ROTATED = r"(?i)^(social media or working until midnight\.?)\s+But In\s+(modern life,?\s+it['’]s very easy to keep scrolling on)\s+s$"
REQUEST = r"(?i)^request\s+[0-9]+\s*\([0-9]+%\)"
NUMBERED = r"^[0-9]+[.)]\s+"
