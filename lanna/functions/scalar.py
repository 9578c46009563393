"""Character-level operators as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kedmanee characters of the keys, row by row: plain, then with shift.
_PLAIN_KEYS = "`1234567890-=" "qwertyuiop[]\\" "asdfghjkl;'" "zxcvbnm,./"
_PLAIN_THAI = "_ๅ/-ภถุึคตจขช" "ๆไำพะัีรนยบลฃ" "ฟหกดเ้่าสวง" "ผปแอิืทมใฝ"
_SHIFT_KEYS = "~!@#$%^&*()_+" "QWERTYUIOP{}|" 'ASDFGHJKL:"' "ZXCVBNM<>?"
_SHIFT_THAI = '%+๑๒๓๔ู฿๕๖๗๘๙' '๐"ฎฑธํ๊ณฯญฐ,ฅ' "ฤฆฏโฌ็๋ษศซ." "()ฉฮฺ์?ฒฬฦ"
KEYS, THAI_KEYS = _PLAIN_KEYS + _SHIFT_KEYS, _PLAIN_THAI + _SHIFT_THAI
_BACK = [(t, k) for k, t in zip(KEYS, THAI_KEYS) if "฀" <= t <= "๿"]
BACK_THAI, BACK_KEYS = "".join(t for t, _ in _BACK), "".join(k for _, k in _BACK)

FORWARD, BACKWARD, BOTH = "qwerty_to_kedmanee", "kedmanee_to_qwerty", "both"


def direction(name: str | None) -> str:
    """A direction from its names; anything unknown is the default, QWERTY to Kedmanee."""
    known = {"kedmanee_to_qwerty": BACKWARD, "th_to_en": BACKWARD, "thai_to_eng": BACKWARD, "both": BOTH, "bidirectional": BOTH}
    return known.get((name or "").strip().lower(), FORWARD)


def to_kedmanee(text: Column) -> Column:
    return F.translate(text, KEYS, THAI_KEYS)


def to_qwerty(text: Column) -> Column:
    return F.translate(text, BACK_THAI, BACK_KEYS)


def keyboard_text(text: Column, way: str | None = None) -> Column:
    """The character filter: converts a whole text before it is cut; `both` works as forward."""
    return to_qwerty(text) if direction(way) == BACKWARD else to_kedmanee(text)


def contains_thai(text: Column) -> Column:
    return F.coalesce(text.rlike("[฀-๿]"), F.lit(False))


def has_thai_letter(text: Column) -> Column:
    return F.coalesce(text.rlike("[ก-๛]"), F.lit(False))


def thai_digits(text: Column) -> Column:
    """Thai digits as ASCII digits."""
    return F.translate(text, "๐๑๒๓๔๕๖๗๘๙", "0123456789")


def contains_thai_digit(text: Column) -> Column:
    return F.coalesce(text.rlike("[๐-๙]"), F.lit(False))


def strip_tones(text: Column, tones: bool = True, thanthakhat: bool = True) -> Column:
    """Without short-vowel and tone marks (U+0E47-0E4B) and silencers (U+0E4C, U+0E4E)."""
    drop = ("็-๋" if tones else "") + ("์๎" if thanthakhat else "")
    return F.regexp_replace(text, f"[{drop}]", "") if drop else text


def lower(text: Column) -> Column:
    """Lower case, each character by itself: no dot is left of a dotted I, and a sigma is one whatever follows."""
    return F.lower(F.translate(text, "İΣ", "iσ"))


SOUND_LETTERS = "กขฃคฅฆงจฉชฌญฎฏฐฑฒณดตถทธนบปผพฝฟภมยรลวศษสหฬอฮ"
_S = f"[{SOUND_LETTERS}]"
#: Pattern and replacement, in order; $1 is the group.
SOUND_RULES = (
    ("รร([เ-ไ])", "ัน$1"), (f"รร({_S}[{SOUND_LETTERS}เ-ไ])", "ั$1"), (f"รร({_S}[ะ-ู่-์])", "ัน$1"), ("รร", "ัน"),
    (f"ไ({_S}ย)", "$1"), (f"[ไใ]({_S})", "$1ย"), ("ำ(ม[ะ-ู])", "ม$1"), ("ำม", "ม"), ("ำ", "ม"),
    (f"จน์|มณ์|ณฑ์|ทร์|ตร์|{_S}์|{_S}[ะ-ู]์", ""), ("[ะ-์]", ""),
)
_FIRST = {"ข": "ขฃคฅฆ", "ช": "ฉชฌ", "ส": "ซศษส", "ด": "ฎด", "ต": "ฏต", "ท": "ฐฑฒถทธ", "น": "ณน", "พ": "ผพภ", "ฟ": "ฝฟ", "ย": "ญย", "ร": "รลฬฤฦ", "ฮ": "หฮ"}
_NEXT = {"0": "มวำ", "1": "กขฃคฅฆ", "2": "งย", "3": "ญณน", "4": "ฎฏดตศษส", "5": "บปพภ", "6": "ผฝฟหอฮ", "7": "จฉชซฌ", "8": "ฐฑฒถทธ", "9": "รฤลฦ"}


def _pairs(table: dict[str, str]) -> tuple[str, str]:
    return "".join(table.values()), "".join(k * len(v) for k, v in table.items())


FIRST_FROM, FIRST_TO = _pairs(_FIRST)
NEXT_FROM, NEXT_TO = _pairs(_NEXT)


def soundex(text: Column) -> Column:
    """The udom83 code: a letter and six digits, empty if nothing is left to code."""
    s = F.coalesce(text, F.lit(""))
    for pattern, to in SOUND_RULES:
        s = F.regexp_replace(s, pattern, to)

    def code(s: Column) -> Column:
        digits = F.concat(F.translate(F.substring(s, 1, 1), FIRST_FROM, FIRST_TO), F.translate(F.substr(s, F.lit(2)), NEXT_FROM, NEXT_TO), F.lit("000000"))
        return F.when(s == "", "").otherwise(F.substring(digits, 1, 7))

    return F.transform(F.array(s), code)[0]  # the rules are applied once, though the code is made of three parts


STRENGTHS = ("primary", "secondary", "tertiary", "identical")
_MARKS = "็-๎"


def _hex(n: Column) -> Column:
    return F.lower(F.lpad(F.hex(n), 6, "0"))


def _weight(c: Column) -> Column:
    """Collation weight of a character."""
    n = F.ascii(c)
    within = lambda a, b: n.between(ord(a), ord(b))
    after = lambda base, a: F.lit(base) + n - F.lit(ord(a))
    return (
        F.when(within("ก", "ฯ"), after(0x010000, "ก")).when(within("เ", "ไ"), after(0x030000, "เ")).when(within("ะ", "ู"), after(0x020000, "ะ"))
        .when(n == ord("ๅ"), 0x02000A).when(within("่", "๋"), after(0x040000, "่")).when(within("็", "๎"), after(0x050000, "็"))
        .when(within("๐", "๙"), after(0x060000, "๐")).otherwise(F.lit(0x100000) + n)
    )


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def collation_key(text: Column, strength: str = "tertiary", decomposition: str = "none") -> Column:
    """A hexadecimal key that sorts in dictionary order; unknown settings are the defaults.

    Six digits a weight: first those of letters and vowels (a leading vowel after its
    consonant), then, but for `primary`, a zero weight and each letter's marks ended
    by one; `secondary` leaves all marks out; `identical` adds the characters.
    """
    strength = strength.lower() if strength and strength.lower() in STRENGTHS else "tertiary"
    whole = F.coalesce(text, F.lit(""))
    if (decomposition or "").lower() in ("canonical", "full"):
        whole = F.replace(whole, F.lit("ำ"), F.lit("ํา"))
    s = F.regexp_replace(whole, "([เ-ไ])([ก-ฯ])", "$2$1")
    weights = lambda x: F.array_join(F.transform(_characters(x), lambda c: _hex(_weight(c))), "")
    key = weights(F.regexp_replace(s, f"[{_MARKS}]", ""))
    if strength != "primary":
        marks = F.regexp_extract_all(s, F.lit(f"([^{_MARKS}])([{_MARKS}]*)"), F.lit(2))
        each = (lambda m: F.lit("000000")) if strength == "secondary" else (lambda m: F.concat(weights(m), F.lit("000000")))
        key = F.concat(key, F.lit("000000"), F.array_join(F.transform(marks, each), ""))
    if strength == "identical":
        key = F.concat(key, F.array_join(F.transform(_characters(whole), lambda c: _hex(F.lit(0x100000) + F.ascii(c))), ""))
    return key


DIGIT_WORDS = {"ศูนย์": 0, "หนึ่ง": 1, "เอ็ด": 1, "สอง": 2, "ยี่": 2, "สาม": 3, "สี่": 4, "ห้า": 5, "หก": 6, "เจ็ด": 7, "แปด": 8, "เก้า": 9}
POWER_WORDS = {"สิบ": 10, "ร้อย": 100, "พัน": 1_000, "หมื่น": 10_000, "แสน": 100_000}
MILLION = "ล้าน"
NUMBER_WORDS = (*DIGIT_WORDS, *POWER_WORDS, MILLION)


def parse_number_words(text: Column) -> Column:
    """The number that Thai number words spell, null if anything else is in the text; long arithmetic wraps."""
    units = F.regexp_extract_all(text, F.lit("(" + "|".join(sorted(NUMBER_WORDS, key=len, reverse=True)) + ")"), F.lit(1))
    pick = lambda table, u: F.coalesce(*[F.when(u == w, F.lit(n).cast("long")) for w, n in table.items()])
    first = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(1).cast("long").alias("digit"), F.lit(False).alias("has"))

    def step(state: Column, u: Column) -> Column:
        factor = F.when(state["has"], state["digit"])
        digit, power = pick(DIGIT_WORDS, u), pick(POWER_WORDS, u)
        one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
        total = F.when(digit.isNotNull(), state["sum"]).when(power.isNotNull(), state["sum"] + F.coalesce(factor, one) * power).otherwise(
            (state["sum"] + F.coalesce(factor, F.when(state["sum"] == 0, one).otherwise(zero))) * F.lit(1_000_000).cast("long")
        )
        return F.struct(total.alias("sum"), F.coalesce(digit, zero).alias("digit"), digit.isNotNull().alias("has"))

    value = F.aggregate(units, first, step, lambda s: s["sum"] + s["digit"])
    return F.when((F.array_join(units, "") != text) | (F.length(text) == 0), None).when(text == "ศูนย์", F.lit(0).cast("long")).otherwise(value)
