"""Runs of number words in a token stream."""

from __future__ import annotations

import re

from lanna.functions.scalar import DIGIT_WORDS, MILLION, NUMBER_WORDS, POWER_WORDS

_UNITS = re.compile("|".join(sorted(NUMBER_WORDS, key=len, reverse=True)))
_DIGITS = str.maketrans("๐๑๒๓๔๕๖๗๘๙", "0123456789")
KIND = "<THAI_NUMBER>"


def parse(text: str | None) -> int | None:
    """The number that Thai number words spell; of digits side by side the last counts; 64-bit arithmetic wraps."""
    if not text or _UNITS.sub("", text):
        return None
    units = _UNITS.findall(text)
    if units == ["ศูนย์"]:
        return 0
    total, digit, has = 0, 1, False
    for u in units:
        if u in DIGIT_WORDS:
            digit, has = DIGIT_WORDS[u], True
            continue
        if u == MILLION:
            total = (total + (digit if has else int(total == 0))) * 1_000_000
        else:
            total += (digit if has else 1) * POWER_WORDS[u]
        digit, has = 0, False
    total += digit
    return (total + (1 << 63)) % (1 << 64) - (1 << 63)


def merge_numbers(tokens: list[tuple], keep: bool, digits: bool, words: bool, least: int) -> list[tuple]:
    """Tokens with the numbers of runs of adjoining number words, and with Thai digits converted."""
    out: list[tuple] = []
    k = 0
    while k < len(tokens):
        t = tokens[k]
        run = k + 1
        if words and parse(t[0]) is not None:
            while run < len(tokens) and tokens[run][1] == tokens[run - 1][2] and parse(tokens[run][0]) is not None:
                run += 1
            own = tokens[k:run]
            value = parse("".join(x[0] for x in own))
            if value is None or value < least:
                out += own
            elif keep:
                out += [t, (str(value), t[1], own[-1][2], 0, len(own), KIND), *own[1:]]
            else:
                out.append((str(value), t[1], own[-1][2], t[3], 1, KIND))
        elif digits and (plain := t[0].translate(_DIGITS)) != t[0]:
            out += [t, (plain, t[1], t[2], 0, t[4], KIND)] if keep else [(plain, *t[1:5], KIND)]
        else:
            out.append(t)
        k = run
    return out
