"""Unit, currency and scale words of several languages, and the reading of figures written with them."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Scale words in rising order of size.
SCALES = {
    1e2: "hundred hundreds सौ 百",
    1e3: "thousand thousands k tsd mil mille millier milliers тыс тысяч тысячи हज़ार हजार 千 พัน ths",
    1e4: "万 萬 หมื่น",
    1e5: "lakh lakhs lac lacs लाख แสน",
    1e6: "million millions mn mln m mio millionen millones millón млн миллионов ล้าน 百万",
    1e7: "crore crores cr करोड़ करोड़",
    1e8: "亿 億",
    1e9: "billion billions bn b mrd milliarden milliarde milliards milliard md mds млрд миллиардов अरब พันล้าน 十亿",
    1e11: "खरब",
    1e12: "trillion trillions tn tr bio billionen billones трлн триллионов 万亿 萬億 兆 ล้านล้าน",
}
# Scales of more than one word.
SCALE_PHRASES = {"lakh crore": 1e12, "lakh crores": 1e12, "lac crore": 1e12, "लाख करोड़": 1e12, "mil millones": 1e9, "mille milliards": 1e12, "thousand crore": 1e10, "thousand million": 1e9}
# Signs, codes and words of currencies.
CURRENCIES = {
    "INR": "₹ rs inr rupee rupees रुपये रुपए रु रुपया", "USD": "$ us$ usd dollar dollars dólares доллар долларов 美元", "EUR": "€ eur euro euros евро 欧元", "GBP": "£ gbp pound-sterling", "JPY": "¥ jpy yen 円 日元",
    "CNY": "cny rmb yuan 元 人民币 元人民币", "NPR": "npr nrs नेरू", "AUD": "a$ aud", "RUB": "₽ rub руб рублей рубля", "THB": "฿ thb baht บาท", "AED": "aed dhs", "SGD": "s$ sgd", "CAD": "c$ cad", "HKD": "hk$ hkd", "CHF": "chf", "KRW": "₩ krw", "LKR": "lkr", "PKR": "pkr", "BDT": "bdt ৳", "NZD": "nz$ nzd", "ZAR": "zar",
}
# Units and their factor to the common unit of their kind.
UNITS = {
    ("percent", "percent", 1.0): "% percent per-cent pct pc prozent pour-cent por-ciento प्रतिशत процента процентов процент 个百分点 百分点 パーセント ポイント เปอร์เซ็นต์ percentage-points percentage-point",
    ("percent", "percent", 0.01): "bps bp basis-points basis-point",
    ("percent", "percent", 100.0): "fraction share-of-1 share",
    ("mass", "kg", 1.0): "kg kgs kilogram kilograms kilogramme kilogrammes किलोग्राम किग्रा кг килограммов 公斤 千克 キログラム กิโลกรัม กก kilogramos kilogramm",
    ("mass", "kg", 1000.0): "t tonne tonnes ton tons mt टन тонн тонны т 吨 噸 トン ตัน toneladas tonelada tonnen",
    ("mass", "kg", 1e6): "kt kilotonnes kilotons",
    ("mass", "kg", 100.0): "quintal quintals क्विंटल quintaux quintales центнеров qtl",
    ("mass", "kg", 0.45359237): "lb lbs pound pounds",
    ("mass", "kg", 0.001): "g gram grams",
    ("duration", "days", 1 / 1440): "min mins minute minutes",
    ("duration", "days", 1 / 24): "h hr hrs hour hours stunden heures horas часов 小时 時間 ชั่วโมง घंटे घंटा",
    ("duration", "days", 1.0): "d day days day(s) tage tag jours jour días día dias дней день дня दिन 天 日 วัน",
    ("duration", "days", 7.0): "week weeks wochen woche semaines semaine semanas semana недель недели सप्ताह 周 週間 週 สัปดาห์",
    ("duration", "days", 30.436875): "month months monate monat mois meses mes месяцев месяца महीने माह 个月 か月 ヶ月 เดือน",
    ("duration", "days", 365.25): "year years yr yrs jahre jahr ans an années años año лет года वर्ष साल 年 ปี",
    ("energy", "kWh", 1.0): "kwh",
    ("energy", "kWh", 1e3): "mwh",
    ("energy", "kWh", 1e6): "gwh",
    ("energy", "kWh", 1e9): "twh",
    ("energy", "kWh", 1 / 3.6): "mj",
    ("energy", "kWh", 1e3 / 3.6): "gj",
    ("energy", "kWh", 1e6 / 3.6): "tj",
    ("energy", "kWh", 1e9 / 3.6): "pj",
    ("area", "ha", 1.0): "ha hectare hectares hektar hectáreas гектаров हेक्टेयर 公顷 ヘクタール เฮกตาร์",
    ("area", "ha", 0.40468564224): "acre acres एकड़ एकड़ acri",
    ("area", "ha", 100.0): "km2 sq-km sqkm square-kilometres वर्ग-किमी км2 кв-км 平方公里 ตร-กม",
    ("area", "ha", 0.0001): "m2 sq-m sqm square-metres वर्ग-मीटर м2 кв-м 平方米 ตร-ม",
    ("temperature", "celsius", 1.0): "°c deg-c degc celsius ℃ grad-c",
    ("temperature", "fahrenheit", 1.0): "°f deg-f degf fahrenheit",
    ("temperature", "kelvin", 1.0): "kelvin deg-k",
    ("count", "count", 1.0): "nos no accounts shipments units number numbers pieces 件 个 शिपमेंट",
}
# Languages that write a decimal comma.
COMMA_LANGS = frozenset("de es fr ru".split())
# Those of them that group thousands with blanks, so that a point marks decimals too.
SPACE_LANGS = frozenset("fr ru".split())

_FIGURE = re.compile(r"[-−–]?\s*\(?\s*[-−]?\s*\d[\d.,'’\s]*\d|[-−–]?\s*\(?\s*[-−]?\s*\d|(?<![A-Za-z\d])[-−]?\.\d+")


def _entries() -> dict[str, tuple]:
    found: dict[str, tuple] = {p: ("scale", v) for p, v in SCALE_PHRASES.items()}
    for value, words in SCALES.items():
        found |= {w: ("scale", value) for w in words.split()}
    for code, words in CURRENCIES.items():
        found |= {w.replace("-", " "): ("currency", code) for w in words.split()}
    for what, words in UNITS.items():
        found |= {w.replace("-", " "): ("unit", *what) for w in words.split()}
    return {unicodedata.normalize("NFKC", k): v for k, v in found.items()}


_ENTRIES = _entries()


def _pattern() -> re.Pattern:
    """Longest word first; words of scripts with spaces only as whole words, signs and other scripts anywhere."""
    parts = []
    for w in sorted(_ENTRIES, key=lambda w: (-len(w), w)):
        body = re.escape(w).replace(r"\ ", r"[\s.]*")
        spaced = re.search(r"[a-zà-ÿа-я]", w)
        parts.append(rf"(?<![a-zà-ÿа-я]){body}(?![a-zà-ÿа-я0-9$])" if spaced and w[0].isalpha() and w[-1] != "$" else body)
    return re.compile("|".join(parts))


_WORDS = _pattern()


@lru_cache(maxsize=100_000)
def said(text: str | None) -> tuple[float | None, str | None, tuple | None]:
    """``(scale, currency, unit)`` that a text states; each None where it states none. The product of scale words
    that stand together counts, a word said twice counts once."""
    if not text:
        return None, None, None
    plain = unicodedata.normalize("NFKC", text).replace("⁄", "/")
    kelvin = re.search(r"(?<![A-Za-z$])K(?![A-Za-z])", plain)
    scales: list[float] = []
    currency = unit = None
    low = plain.lower()
    for m in _WORDS.finditer(low):
        hit = _ENTRIES.get(re.sub(r"[\s.]+", " ", m[0])) or _ENTRIES[m[0]]
        if hit[0] == "scale":
            if hit[1] not in scales:
                scales.append(hit[1])
        elif hit[0] == "currency":
            currency = currency or hit[1]
        elif unit is None or unit[0] == "count":
            unit = hit[1:]
    if kelvin and currency is None and (unit is None or unit[0] == "count") and 1e3 in scales:
        scales.remove(1e3)
        unit = ("temperature", "kelvin", 1.0)
    scale = None
    for s in scales:
        scale = s if scale is None else scale * s
    return scale, currency, unit


def figure(raw: str | None, lang: str | None) -> tuple[float, str] | None:
    """The figure in a text by the writing habits of ``lang``, and the text around it; None where there is none."""
    if not raw:
        return None
    text = unicodedata.normalize("NFKC", raw)
    text = "".join(str(unicodedata.decimal(c)) if c.isdecimal() else c for c in text)
    text = re.sub("[­​-‏⁠﻿]", "", text)
    m = _FIGURE.search(text)
    if m is None:
        return None
    start = m.start()
    body = m[0]
    tail = text[m.end() :]
    before = text[:start]
    negative = bool(re.search(r"[-−–]", body)) or bool(re.search(r"[-−–]\s*[^\s\d]{0,4}\s*$", before) and re.match(r"^\s*[-−–]", before))
    opened = "(" in body or re.search(r"\([^)]*$", before)
    negative = negative or bool(opened and ")" in tail)
    digits = re.sub(r"[^\d.,]", "", body)
    decimal = "," if (lang or "")[:2].lower() in COMMA_LANGS else "."
    group = "." if decimal == "," else ","
    if decimal == "," and (lang or "")[:2].lower() in SPACE_LANGS and "," not in digits and digits.count(".") == 1:
        decimal, group = ".", ","
    whole, _, rest = digits.replace(group, "").partition(decimal)
    if rest and (decimal in rest or group in digits.rpartition(decimal)[2]):
        # The mark of the decimals repeats or stands before a group: it parts groups here.
        whole, rest = re.sub(r"\D", "", digits), ""
    elif not rest and digits.count(group) == 1 and len(digits.rpartition(group)[2]) != 3 and digits[0] != group:
        # One group mark with other than two or three digits after it can only mark decimals.
        whole, _, rest = digits.partition(group)
    value = float(f"{whole or 0}.{rest or 0}")
    return (-value if negative else value), f"{before} {tail}"
