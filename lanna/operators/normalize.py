"""Spelling normalization, and the matching form that the segmenter looks words up by."""

from __future__ import annotations

TONES = frozenset("่้๊๋")
_ABOVE_BELOW = frozenset("ัิีึืฺุู็")
_FOLLOW = frozenset("ะาำๅ")
_DANGLING = _ABOVE_BELOW | TONES | frozenset("์ํ๎")
_ONCE = frozenset(map(chr, [*range(0x0E30, 0x0E3B), 0x0E45, *range(0x0E47, 0x0E4F)]))
_TOUCHED = _ONCE | frozenset(map(chr, range(0x0E30, 0x0E4F))) | frozenset("​‌")


def _composed(s: list[str]) -> list[str]:
    """Doubled leading vowels, split am vowels and long aa, from left to right."""
    out: list[str] = []
    k = 0
    while k < len(s):
        c, rest = s[k], s[k + 1 : k + 3]
        if c == "เ" and rest[:1] == ["เ"]:
            out.append("แ")
            k += 2
        elif c == "ํ" and rest[:1] == ["า"]:
            out.append("ำ")
            k += 2
        elif c == "ํ" and len(rest) == 2 and rest[0] in TONES and rest[1] == "า":
            # The am vowel is looked at again, but none of the rules begins with it.
            out += [rest[0], "ำ"]
            k += 3
        elif c in TONES and rest == ["ํ", "า"]:
            out += [c, "ำ"]
            k += 3
        else:
            out.append("า" if c == "ๅ" and (not out or out[-1] not in "ฤฦ") else c)
            k += 1
    return out


def normalize(text: str | None) -> str | None:
    """Canonical spelling: no zero-width or leading marks, composed vowels, marks in order, none twice, the last of several tones."""
    if not text or not any(c in _TOUCHED for c in text):
        return text
    s = [c for c in text if c not in "​‌"]
    start = 0
    while start < len(s) and s[start] in _DANGLING:
        start += 1
    s = _composed(s[start:])
    moved = True
    while moved:  # passes from left to right, as the order of three marks depends on it
        moved = False
        for k in range(len(s) - 1):
            a, b = s[k], s[k + 1]
            if ((a in TONES or a == "์") and b in _ABOVE_BELOW) or (a in _FOLLOW and b in TONES):
                s[k], s[k + 1] = b, a
                moved = True
    out: list[str] = []
    for c in s:
        if out and out[-1] == c and c in _ONCE:
            continue
        if out and c in TONES and out[-1] in TONES:
            out[-1] = c
            while len(out) > 1 and out[-2] == c:
                out.pop()
            continue
        out.append(c)
    return "".join(out)


def matching(text: str) -> tuple[str, list[int]]:
    """The matching form and, for each of its places and the end, the place in the text."""
    out: list[str] = []
    at: list[int] = []
    k, n = 0, len(text)
    while k < n:
        c, a, b = text[k], text[k + 1 : k + 2], text[k + 2 : k + 3]
        if c == "เ" and a == "เ":
            made, used = "แ", 2
        elif c == "ำ" and a in TONES:
            made, used = a + "ำ", 2
        elif c == "ํ" and a == "า":
            made, used = ("ำ", 2) if b not in TONES else (b + "ำ", 3)
        elif c == "ํ" and a in TONES and b == "า":
            made, used = a + "ำ", 3
        else:
            made, used = c, 1
        out.append(made)
        at += [k] * len(made)
        k += used
    return "".join(out), [*at, n]


def match_form(word: str) -> str:
    return matching(word)[0]
