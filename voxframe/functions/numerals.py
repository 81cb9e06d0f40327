"""Spelled numbers as digits in seven languages: a small grammar of units, tens, hundreds, scales and joins.

The forms under a hundred follow from each language's units and tens by its own rule; the rest is one walk over words.
"""

from __future__ import annotations

import re
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The words of each language in the order of their numbers, from 0 on and from 20 on by tens.
_UNITS = {
    "en": "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze seize",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciséis diecisiete dieciocho diecinueve",
    "pt": "zero um dois três quatro cinco seis sete oito nove dez onze doze treze catorze quinze dezasseis dezassete dezoito dezanove",
    "it": "zero uno due tre quattro cinque sei sette otto nove dieci undici dodici tredici quattordici quindici sedici diciassette diciotto diciannove",
    "de": "null eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn",
    "nl": "nul een twee drie vier vijf zes zeven acht negen tien elf twaalf dertien veertien vijftien zestien zeventien achttien negentien",
}
_TENS = {
    "en": "twenty thirty forty fifty sixty seventy eighty ninety",
    "fr": "vingt trente quarante cinquante soixante",
    "es": "veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa",
    "pt": "vinte trinta quarenta cinquenta sessenta setenta oitenta noventa",
    "it": "venti trenta quaranta cinquanta sessanta settanta ottanta novanta",
    "de": "zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig",
    "nl": "twintig dertig veertig vijftig zestig zeventig tachtig negentig",
}
_ALSO = {
    "fr": {"une": 1, "zero": 0}, "es": {"un": 1, "una": 1, "veintiún": 21}, "pt": {"uma": 1, "duas": 2, "dezesseis": 16, "dezessete": 17, "dezenove": 19},
    "it": {"un": 1, "una": 1}, "de": {"ein": 1, "eine": 1, "dreissig": 30}, "nl": {"één": 1},
}
_HUNDREDS = {
    "en": {"hundred": 0}, "fr": {"cent": 0, "cents": 0}, "it": {"cento": 0}, "de": {"hundert": 0}, "nl": {"honderd": 0},
    "es": {"cien": 1, "ciento": 1} | dict(zip("doscientos trescientos cuatrocientos quinientos seiscientos setecientos ochocientos novecientos".split(), range(2, 10), strict=True)),
    "pt": {"cem": 1, "cento": 1} | dict(zip("duzentos trezentos quatrocentos quinhentos seiscentos setecentos oitocentos novecentos".split(), range(2, 10), strict=True)),
}
_SCALES = {
    "en": {"thousand": 3, "million": 6}, "fr": {"mille": 3, "million": 6, "millions": 6}, "es": {"mil": 3, "millón": 6, "millones": 6},
    "pt": {"mil": 3, "milhão": 6, "milhões": 6}, "it": {"mille": 3, "mila": 3, "milione": 6, "milioni": 6},
    "de": {"tausend": 3, "million": 6, "millionen": 6}, "nl": {"duizend": 3, "miljoen": 6},
}
_JOINS = {"en": "and", "pt": "e", "de": "und", "nl": "en"}
#: Languages that write a number as one word.
_COMPOUND = ("it", "de", "nl")
LANGUAGES = tuple(_UNITS)


@cache
def small_numbers(lang: str) -> dict[str, int]:
    """The forms of 0 to 99, hyphens as blanks."""
    units, tens = _UNITS[lang].split(), _TENS[lang].split()
    out = {w: n for n, w in enumerate(units)} | _ALSO.get(lang, {})
    if lang == "fr":
        def after(word: str, base: int, most: int) -> None:
            for n in range(1, most):
                unit = units[n] if n <= 16 else f"dix {units[n - 10]}"
                out[f"{word} et {unit}" if n in (1, 11) and base < 80 else f"{word} {unit}"] = base + n

        out.update({f"dix {units[n]}": 10 + n for n in (7, 8, 9)})
        out.update({"quatre vingt": 80, "quatre vingts": 80})
        for k, word in enumerate(tens):
            out[word] = 20 + 10 * k
            after(word, 20 + 10 * k, 20 if word == "soixante" else 10)
        after("quatre vingt", 80, 20)
        return out
    for k, word in enumerate(tens):
        base = 20 + 10 * k
        out[word] = base
        for n in range(1, 10):
            unit = units[n]
            if lang == "en":
                form = f"{word} {unit}"
            elif lang == "es":
                form = f"{word} y {unit}" if base > 20 else "veinti" + {"dos": "dós", "tres": "trés", "seis": "séis"}.get(unit, unit)
            elif lang == "pt":
                form = f"{word} e {unit}"
            elif lang == "it":
                form = (word[:-1] if unit[0] in "uo" else word) + ("tré" if n == 3 else unit)
            elif lang == "de":
                form = ("ein" if n == 1 else unit) + "und" + word
            else:
                form = unit + ("ën" if unit[-1] == "e" else "en") + word
            out[form] = base + n
    return out


@cache
def _lexemes(lang: str) -> dict[str, tuple[str, int]]:
    out = {w: ("small", n) for w, n in small_numbers(lang).items()}
    out |= {w: ("hundred", n) for w, n in _HUNDREDS[lang].items()} | {w: ("scale", 10**n) for w, n in _SCALES[lang].items()}
    return out | ({_JOINS[lang]: ("join", 0)} if lang in _JOINS else {})


@cache
def _splitter(lang: str) -> re.Pattern:
    """The parts of a compound, longest first; the whole word must be made of them."""
    parts = sorted(_lexemes(lang), key=len, reverse=True)
    return re.compile("|".join(map(re.escape, parts)))


def _parts(lang: str, words: list[str], i: int) -> tuple[list[tuple[str, int]], int] | None:
    """The parts that start at a word, and how many words they take."""
    known = _lexemes(lang)
    for n in range(min(4, len(words) - i), 0, -1):
        form = " ".join(words[i : i + n])
        if form in known:
            return [known[form]], n
    if lang in _COMPOUND:
        found, at = [], 0
        while at < len(words[i]):
            m = _splitter(lang).match(words[i], at)
            if not m:
                return None
            found.append(known[m[0]])
            at = m.end()
        return found, 1
    return None


def _walk(lang: str, words: list[str], i: int) -> tuple[int, int]:
    """(value, words) of the longest number that starts at a word; no words where there is none."""
    total, now, scale, used, value, parts = 0, None, 10**9, 0, 0, 0
    at = i
    while at < len(words):
        found = _parts(lang, words, at)
        if not found:
            break
        ok = True
        for kind, n in found[0]:
            if kind == "small":
                ok = now is None or (now and now % 100 == 0 and 0 < n)
                now = (now or 0) + n
            elif kind == "hundred" and n:
                ok, now = now is None, n * 100
            elif kind == "hundred":
                ok, now = now is None or 1 <= now <= 9, (1 if now is None else now) * 100
            elif kind == "scale":
                ok = n < scale and now != 0
                total, now, scale = total + (1 if now is None else now) * n, None, n
            else:
                ok = now is not None and now % 100 == 0 and now > 0 or (now is None and total > 0)
            if not ok:
                break
            parts += kind != "join"
        if not ok:
            break
        at += found[1]
        if found[0][-1][0] != "join":  # a join must be followed by something
            used, value = at - i, total + (now or 0)
            single = parts == 1 and found[0][0][0] == "small"
    if used and single and value < 2:
        return 0, 0  # alone, these are articles as often as numbers
    return value, used


_TOKEN = re.compile(r"[^\W\d_]+")


def spelled_to_digits(text: str, lang: str) -> str:
    """A text with its spelled numbers as digits.  One and zero alone stay, and so do texts in other languages."""
    if lang not in _UNITS or not text:
        return text
    found = list(_TOKEN.finditer(text))
    words = [m[0].lower() for m in found]
    # Numbers do not reach over anything but single blanks and hyphens
    breaks = [not re.fullmatch(r"[  ]+|-", text[a.end() : b.start()]) for a, b in zip(found, found[1:], strict=False)] + [True]
    out, last, i = [], 0, 0
    while i < len(words):
        stop = i
        if _parts(lang, words[i : i + 4], 0) is not None:
            while not breaks[stop]:
                stop += 1
                if stop - i > 24:
                    break
        value, used = _walk(lang, words[i : stop + 1], 0) if stop >= i else (0, 0)
        if used:
            out += [text[last : found[i].start()], str(value)]
            last, i = found[i + used - 1].end(), i + used
        else:
            i += 1
    return "".join([*out, text[last:]])


def digits(text: Column, lang: Column) -> Column:
    """Spelled numbers of a text in digits, in the language of its row."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, langs: pd.Series) -> pd.Series:
        return pd.Series([t if t is None else spelled_to_digits(t, x) for t, x in zip(texts, langs, strict=True)], dtype=object)

    return run(text, lang)
