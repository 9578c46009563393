"""What the queries over Thai sentences give: rows written down and checked by hand against the published rules.

A token is written as its term, start-end, increment/length where that is not 1/1, and a letter for its type.
"""

from __future__ import annotations

TEXTS = (
    "เด็กซื้อหนังสือที่ตลาด",
    "เขากินข้าวกับน้ำปลา",
    "คนไข้พบหมอที่รพ.",
    "พ.ต.ท.สมชายกล่าวว่าไม่ได้ไป",
    "เราเดินทางไปจ.ตรังเมื่อ ก.พ.",
    "ราคาห้าหมื่นบาท",
    "ห้อง๑๒ ชั้น๓",
    "เด็กๆใช้ภาษาไทยใน AI 2.5%",
    "นํ้าตาลทรายเเละข้าว",
    "ศิริวัฒน์และเครื่องบินที่สนามบิน",
    "ทีวีบีเล่นl;ylfu",
    "หรือไม่.",
)

KINDS = {"T": "<THAI>", "A": "<ALPHANUM>", "K": "<KEYBOARD_CORRECTED>", "P": "<PHONETIC>", "S": "<TONE_STRIPPED>", "N": "<THAI_NUMBER>", "X": "<ACRONYM_EXPANDED>", "R": "<ROMANIZATION>"}


def tokens(block: str) -> list[tuple]:
    """(text, position, term, start, end, increment, length, type) of a block with a line a text."""
    rows = []
    for k, line in enumerate(block.strip().splitlines()):
        position = -1
        for token in line.split(" | "):
            term, place, *graph, kind = token.split(" ")
            start, end = map(int, place.split("-"))
            step, length = map(int, graph[0].split("/")) if graph else (1, 1)
            position += step
            rows.append((k, position, term, start, end, step, length, KINDS[kind]))
    return rows


def values_sql(rows: list[tuple], columns: str, select: str) -> str:
    """A query over rows that are written down, as table e."""

    def show(x) -> str:
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else "[" + ", ".join(map(str, x)) + "]" if isinstance(x, tuple) else str(x)

    written = ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows)
    return f"WITH e({columns}) AS (VALUES {written}) " + select.replace("{texts}", str(len(TEXTS)))


#: The standard preset.
WORDS = """
เด็ก 0-4 T | ซื้อ 4-8 T | หนังสือ 8-15 T | ที่ 15-18 T | ตลาด 18-22 T
เขา 0-3 T | กิน 3-6 T | ข้าว 6-10 T | กับ 10-13 T | น้ำปลา 13-19 T
คนไข้ 0-5 T | พบ 5-7 T | หมอ 7-10 T | ที่ 10-13 T | รพ. 13-16 T
พ.ต.ท. 0-6 T | สม 6-8 T | ชาย 8-11 T | กล่าว 11-16 T | ว่า 16-19 T | ไม่ 19-22 T | ได้ 22-25 T | ไป 25-27 T
เรา 0-3 T | เดินทาง 3-10 T | ไป 10-12 T | จ. 12-14 T | ตรัง 14-18 T | เมื่อ 18-23 T | ก.พ. 24-28 T
ราคา 0-4 T | ห้า 4-7 T | หมื่น 7-12 T | บาท 12-15 T
ห้อง 0-4 T | ๑๒ 4-6 T | ชั้น 7-11 T | ๓ 11-12 T
เด็กๆ 0-5 T | ใช้ 5-8 T | ภาษา 8-12 T | ไทย 12-15 T | ใน 15-17 T | ai 18-20 A | 2.5% 21-25 A
น้ำตาล 0-7 T | ทราย 7-11 T | และ 11-15 T | ข้าว 15-19 T
ศิริวัฒน์ 0-9 T | และ 9-12 T | เครื่องบิน 12-22 T | ที่ 22-25 T | สนามบิน 25-32 T
ทีวีบี 0-6 T | เล่น 6-10 T | l 10-11 A | ; 11-12 A | ylfu 12-16 A
หรือ 0-4 T | ไม่ 4-7 T | . 7-8 A
"""

#: Compounds and their parts, in the text's own spelling.
MIXED = """
เด็ก 0-4 T | ซื้อ 4-8 T | หนังสือ 8-15 T | ที่ 15-18 T | ตลาด 18-22 T
เขา 0-3 T | กิน 3-6 T | ข้าว 6-10 T | กับ 10-13 T | น้ำปลา 13-19 1/2 T | น้ำ 13-16 0/1 T | ปลา 16-19 T
คนไข้ 0-5 1/2 T | คน 0-2 0/1 T | ไข้ 2-5 T | พบ 5-7 T | หมอ 7-10 T | ที่ 10-13 T | รพ. 13-16 T
พ.ต.ท. 0-6 T | สม 6-8 T | ชาย 8-11 T | กล่าว 11-16 T | ว่า 16-19 T | ไม่ 19-22 T | ได้ 22-25 T | ไป 25-27 T
เรา 0-3 T | เดินทาง 3-10 1/2 T | เดิน 3-7 0/1 T | ทาง 7-10 T | ไป 10-12 T | จ. 12-14 T | ตรัง 14-18 T | เมื่อ 18-23 T | ก.พ. 24-28 T
ราคา 0-4 T | ห้า 4-7 T | หมื่น 7-12 T | บาท 12-15 T
ห้อง 0-4 T | ๑๒ 4-6 T | ชั้น 7-11 T | ๓ 11-12 T
เด็กๆ 0-5 1/2 T | เด็ก 0-4 0/1 T | ๆ 4-5 T | ใช้ 5-8 T | ภาษา 8-12 T | ไทย 12-15 T | ใน 15-17 T | AI 18-20 A | 2.5% 21-25 A
นํ้าตาล 0-7 T | ทราย 7-11 T | เเละ 11-15 T | ข้าว 15-19 T
ศิริวัฒน์ 0-9 T | และ 9-12 T | เครื่องบิน 12-22 1/2 T | เครื่อง 12-19 0/1 T | บิน 19-22 T | ที่ 22-25 T | สนามบิน 25-32 1/2 T | สนาม 25-29 0/1 T | บิน 29-32 T
ทีวีบี 0-6 T | เล่น 6-10 T | l 10-11 A | ; 11-12 A | ylfu 12-16 A
หรือ 0-4 T | ไม่ 4-7 T | . 7-8 A
"""

#: The preset for names.
PERSON = """
เด็ก 0-4 T | ด100000 0-4 0/1 P | เดก 0-4 0/1 S | ด100000 0-4 0/1 P | ซื้อ 4-8 T | ส600000 4-8 0/1 P | ซือ 4-8 0/1 S | ส600000 4-8 0/1 P | หนังสือ 8-15 T | ฮ324600 8-15 0/1 P | ที่ 15-18 T | ท000000 15-18 0/1 P | ที 15-18 0/1 S | ตลาด 18-22 T | ต940000 18-22 0/1 P
เขา 0-3 T | ข000000 0-3 0/1 P | กิน 3-6 T | ก300000 3-6 0/1 P | ข้าว 6-10 T | ข000000 6-10 0/1 P | ขาว 6-10 0/1 S | ข000000 6-10 0/1 P | กับ 10-13 T | ก500000 10-13 0/1 P | น้ำปลา 13-19 1/2 T | น059000 13-19 0/2 P | นำปลา 13-19 0/2 S | น059000 13-19 0/2 P | น้ำ 13-16 0/1 T | ปลา 16-19 T
คนไข้ 0-5 1/2 T | ข312000 0-5 0/2 P | คนไข 0-5 0/2 S | ข312000 0-5 0/2 P | คน 0-2 0/1 T | ไข้ 2-5 T | พบ 5-7 T | หมอ 7-10 T | ฮ060000 7-10 0/1 P | ที่ 10-13 T | ท000000 10-13 0/1 P | ที 10-13 0/1 S | รพ. 13-16 T | ร5.0000 13-16 0/1 P
พ.ต.ท. 0-6 T | พ.4.8.0 0-6 0/1 P | สม 6-8 T | ชาย 8-11 T | ช200000 8-11 0/1 P | กล่าว 11-16 T | ก900000 11-16 0/1 P | กลาว 11-16 0/1 S | ก900000 11-16 0/1 P | ว่า 16-19 T | ว000000 16-19 0/1 P | วา 16-19 0/1 S | ไม่ 19-22 T | ม200000 19-22 0/1 P | ไม 19-22 0/1 S | ได้ 22-25 T | ด200000 22-25 0/1 P | ได 22-25 0/1 S | ไป 25-27 T
เรา 0-3 T | ร000000 0-3 0/1 P | เดินทาง 3-10 1/2 T | ด382000 3-10 0/2 P | เดิน 3-7 0/1 T | ทาง 7-10 T | ไป 10-12 T | จ. 12-14 T | ตรัง 14-18 T | ต920000 14-18 0/1 P | เมื่อ 18-23 T | ม600000 18-23 0/1 P | เมือ 18-23 0/1 S | ม600000 18-23 0/1 P | ก.พ. 24-28 T | ก.5.000 24-28 0/1 P
ราคา 0-4 T | ร100000 0-4 0/1 P | ห้า 4-7 T | ฮ000000 4-7 0/1 P | หา 4-7 0/1 S | หมื่น 7-12 T | ฮ030000 7-12 0/1 P | หมืน 7-12 0/1 S | ฮ030000 7-12 0/1 P | บาท 12-15 T | บ800000 12-15 0/1 P
ห้อง 0-4 T | ฮ620000 0-4 0/1 P | หอง 0-4 0/1 S | ฮ620000 0-4 0/1 P | ๑๒ 4-6 T | ชั้น 7-11 T | ช300000 7-11 0/1 P | ชัน 7-11 0/1 S | ช300000 7-11 0/1 P | ๓ 11-12 T
เด็กๆ 0-5 1/2 T | ด100000 0-5 0/2 P | เดกๆ 0-5 0/2 S | ด100000 0-5 0/2 P | เด็ก 0-4 0/1 T | ๆ 4-5 T | ใช้ 5-8 T | ช200000 5-8 0/1 P | ใช 5-8 0/1 S | ภาษา 8-12 T | พ400000 8-12 0/1 P | ไทย 12-15 T | ท200000 12-15 0/1 P | ใน 15-17 T | ai 18-20 A | 2.5% 21-25 A
น้ำตาล 0-7 T | น049000 0-7 0/1 P | นำตาล 0-7 0/1 S | น049000 0-7 0/1 P | ทราย 7-11 T | ท920000 7-11 0/1 P | และ 11-15 T | ร000000 11-15 0/1 P | ข้าว 15-19 T | ข000000 15-19 0/1 P | ขาว 15-19 0/1 S | ข000000 15-19 0/1 P
ศิริวัฒน์ 0-9 T | ส908000 0-9 0/1 P | ศิริวัฒน 0-9 0/1 S | ส908300 0-9 0/1 P | และ 9-12 T | ร000000 9-12 0/1 P | เครื่องบิน 12-22 1/2 T | ข962530 12-22 0/2 P | เครืองบิน 12-22 0/2 S | ข962530 12-22 0/2 P | เครื่อง 12-19 0/1 T | บิน 19-22 T | ที่ 22-25 T | ท000000 22-25 0/1 P | ที 22-25 0/1 S | สนามบิน 25-32 1/2 T | ส305300 25-32 0/2 P | สนาม 25-29 0/1 T | บิน 29-32 T
ทีวีบี 0-6 T | ท050000 0-6 0/1 P | เล่น 6-10 T | ร300000 6-10 0/1 P | เลน 6-10 0/1 S | ร300000 6-10 0/1 P | l 10-11 A | ; 11-12 A | ylfu 12-16 A
หรือ 0-4 T | ฮ960000 0-4 0/1 P | ไม่ 4-7 T | ม200000 4-7 0/1 P | ไม 4-7 0/1 S | . 7-8 A
"""

#: Lower case, numbers, short forms, Latin spelling.
CUSTOM = """
เด็ก 0-4 T | dek 0-4 0/1 R | ซื้อ 4-8 T | sue 4-8 0/1 R | หนังสือ 8-15 T | nangsue 8-15 0/1 R | ที่ 15-18 T | thi 15-18 0/1 R | ตลาด 18-22 T | tlat 18-22 0/1 R
เขา 0-3 T | khao 0-3 0/1 R | กิน 3-6 T | kin 3-6 0/1 R | ข้าว 6-10 T | khao 6-10 0/1 R | กับ 10-13 T | kap 10-13 0/1 R | น้ำปลา 13-19 T | nampla 13-19 0/1 R
คนไข้ 0-5 T | khanakhai 0-5 0/1 R | พบ 5-7 T | phop 5-7 0/1 R | หมอ 7-10 T | mo 7-10 0/1 R | ที่ 10-13 T | thi 10-13 0/1 R | รพ. 13-16 T | raph. 13-16 0/1 R | โรงพยาบาล 13-16 0/1 X | rongpyaban 13-16 0/1 R
พ.ต.ท. 0-6 T | ph.t.th. 0-6 0/1 R | พันตำรวจโท 0-6 0/1 X | phantamruattho 0-6 0/1 R | สม 6-8 T | som 6-8 0/1 R | ชาย 8-11 T | chai 8-11 0/1 R | กล่าว 11-16 T | klao 11-16 0/1 R | ว่า 16-19 T | wa 16-19 0/1 R | ไม่ 19-22 T | mai 19-22 0/1 R | ได้ 22-25 T | dai 22-25 0/1 R | ไป 25-27 T | pai 25-27 0/1 R
เรา 0-3 T | rao 0-3 0/1 R | เดินทาง 3-10 T | doenthang 3-10 0/1 R | ไป 10-12 T | pai 10-12 0/1 R | จ. 12-14 T | ch. 12-14 0/1 R | จังหวัด 12-14 0/1 X | changwat 12-14 0/1 R | ตรัง 14-18 T | trang 14-18 0/1 R | เมื่อ 18-23 T | muea 18-23 0/1 R | ก.พ. 24-28 T | k.ph. 24-28 0/1 R | กุมภาพันธ์ 24-28 0/1 X | kumphaphan 24-28 0/1 R
ราคา 0-4 T | rakha 0-4 0/1 R | ห้า 4-7 T | ha 4-7 0/1 R | 50000 4-12 0/2 N | หมื่น 7-12 T | muen 7-12 0/1 R | บาท 12-15 T | bat 12-15 0/1 R
ห้อง 0-4 T | hong 0-4 0/1 R | ๑๒ 4-6 T | 12 4-6 0/1 N | ชั้น 7-11 T | chan 7-11 0/1 R | ๓ 11-12 T | 3 11-12 0/1 N
เด็กๆ 0-5 T | dek 0-5 0/1 R | ใช้ 5-8 T | chai 5-8 0/1 R | ภาษา 8-12 T | phasa 8-12 0/1 R | ไทย 12-15 T | thai 12-15 0/1 R | ใน 15-17 T | nai 15-17 0/1 R | ai 18-20 A | 2.5% 21-25 A
นํ้าตาล 0-7 T | natan 0-7 0/1 R | ทราย 7-11 T | thrai 7-11 0/1 R | เเละ 11-15 T | เleะ 11-15 0/1 R | ข้าว 15-19 T | khao 15-19 0/1 R
ศิริวัฒน์ 0-9 T | siriwat 0-9 0/1 R | และ 9-12 T | lae 9-12 0/1 R | เครื่องบิน 12-22 T | kheruengbin 12-22 0/1 R | ที่ 22-25 T | thi 22-25 0/1 R | สนามบิน 25-32 T | sanambin 25-32 0/1 R
ทีวีบี 0-6 T | thiwibi 0-6 0/1 R | เล่น 6-10 T | len 6-10 0/1 R | l 10-11 A | ; 11-12 A | ylfu 12-16 A
หรือ 0-4 T | rue 0-4 0/1 R | ไม่ 4-7 T | mai 4-7 0/1 R | . 7-8 A
"""

#: Canonical spelling in lower case.
NORMAL = [
    (0, "เด็กซื้อหนังสือที่ตลาด"),
    (1, "เขากินข้าวกับน้ำปลา"),
    (2, "คนไข้พบหมอที่รพ."),
    (3, "พ.ต.ท.สมชายกล่าวว่าไม่ได้ไป"),
    (4, "เราเดินทางไปจ.ตรังเมื่อ ก.พ."),
    (5, "ราคาห้าหมื่นบาท"),
    (6, "ห้อง๑๒ ชั้น๓"),
    (7, "เด็กๆใช้ภาษาไทยใน ai 2.5%"),
    (8, "น้ำตาลทรายและข้าว"),
    (9, "ศิริวัฒน์และเครื่องบินที่สนามบิน"),
    (10, "ทีวีบีเล่นl;ylfu"),
    (11, "หรือไม่."),
]

#: What the rules of romanization make of each word.
LATIN = [
    (0, "เด็ก", "dek"), (0, "ซื้อ", "sue"), (0, "หนังสือ", "nangsue"), (0, "ที่", "thi"), (0, "ตลาด", "tlat"),
    (1, "เขา", "khao"), (1, "กิน", "kin"), (1, "ข้าว", "khao"), (1, "กับ", "kap"), (1, "น้ำปลา", "nampla"),
    (2, "คนไข้", "khanakhai"), (2, "พบ", "phop"), (2, "หมอ", "mo"), (2, "ที่", "thi"), (2, "รพ.", "raph."),
    (3, "พ.ต.ท.", "ph.t.th."), (3, "สม", "som"), (3, "ชาย", "chai"), (3, "กล่าว", "klao"), (3, "ว่า", "wa"), (3, "ไม่", "mai"), (3, "ได้", "dai"), (3, "ไป", "pai"),
    (4, "เรา", "rao"), (4, "เดินทาง", "doenthang"), (4, "ไป", "pai"), (4, "จ.", "ch."), (4, "ตรัง", "trang"), (4, "เมื่อ", "muea"), (4, "ก.พ.", "k.ph."),
    (5, "ราคา", "rakha"), (5, "ห้า", "ha"), (5, "หมื่น", "muen"), (5, "บาท", "bat"),
    (6, "ห้อง", "hong"), (6, "๑๒", "๑๒"), (6, "ชั้น", "chan"), (6, "๓", "๓"),
    (7, "เด็กๆ", "dek"), (7, "ใช้", "chai"), (7, "ภาษา", "phasa"), (7, "ไทย", "thai"), (7, "ใน", "nai"),
    (8, "นํ้าตาล", "natan"), (8, "ทราย", "thrai"), (8, "เเละ", "เleะ"), (8, "ข้าว", "khao"),
    (9, "ศิริวัฒน์", "siriwat"), (9, "และ", "lae"), (9, "เครื่องบิน", "kheruengbin"), (9, "ที่", "thi"), (9, "สนามบิน", "sanambin"),
    (10, "ทีวีบี", "thiwibi"), (10, "เล่น", "len"),
    (11, "หรือ", "rue"), (11, "ไม่", "mai"),
]

#: The last good place to cut a text.
CUTS = [(0, 21), (1, 17), (2, 16), (3, 6), (4, 24), (5, 14), (6, 7), (7, 21), (8, 18), (9, 31), (10, 12), (11, 8)]

#: Phrases whose terms are parted by blanks, and the texts that hold them if compounds and parts are indexed: a compound takes one place, so its parts, not itself, lead on to the next word.
SOUGHT = ("สนามบิน", "สนาม บิน", "ที่ สนามบิน", "เดินทาง ไป", "เดิน ทาง ไป", "น้ำตาล ทราย", "เด็ก ซื้อ หนังสือ", "ไป เดินทาง", "กับ น้ำปลา", "บิน ที่")
PHRASES = [
    (0, "เด็ก ซื้อ หนังสือ"), (1, "กับ น้ำปลา"), (4, "เดิน ทาง ไป"), (8, "น้ำตาล ทราย"), (9, "สนามบิน"), (9, "สนาม บิน"), (9, "ที่ สนามบิน"), (9, "บิน ที่"),
]

#: Search words, and the texts they find under each setting.  Compounds are parted before their spelling is normalized, so the text's odd spelling of น้ำตาล stays whole.
ASKED = ("สนามบิน", "บิน", "เดินทาง", "น้ำตาล", "เด็ก")
PAIR_HITS = [
    ("none/none", "สนามบิน", (9,)), ("none/none", "เดินทาง", (4,)), ("none/none", "น้ำตาล", (8,)), ("none/none", "เด็ก", (0,)),
    *((config, q, hits) for config in ("mixed/none", "layered 3:1", "layered 1:1") for q, hits in (("สนามบิน", (9,)), ("บิน", (9,)), ("เดินทาง", (4,)), ("น้ำตาล", (8,)), ("เด็ก", (0, 7)))),
    *((config, q, hits) for config in ("mixed/mixed", "discard/discard") for q, hits in (("สนามบิน", (9,)), ("บิน", (9,)), ("เดินทาง", (4,)), ("เด็ก", (0, 7)))),
]
