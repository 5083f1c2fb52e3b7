"""Stems of Russian words as column expressions, by the published Snowball rules for Russian."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VOWELS = "аеиоуыэюя"
# Endings of the published rules. Those of the first group count only after а or я.
GERUNDS = ("в вши вшись", "ив ивши ившись ыв ывши ывшись")
ADJECTIVES = "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею"
PARTICIPLES = ("ем нн вш ющ щ", "ивш ывш ующ")
VERBS = (
    "ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно",
    "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю",
)
NOUNS = "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я"


def _any(endings: str) -> str:
    return f"(?:{'|'.join(endings.split())})"


def _grouped(groups: tuple[str, str]) -> str:
    return f"(?:(?<=[ая]){_any(groups[0])}|{_any(groups[1])})"


_GERUND = _grouped(GERUNDS) + "$"
_ADJECTIVE = f"{_grouped(PARTICIPLES)}?{_any(ADJECTIVES)}$"
_VERB = _grouped(VERBS) + "$"
_NOUN = _any(NOUNS) + "$"


def _once(value: Column, body) -> Column:
    """``body(v)`` with ``value`` computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _without(x: Column, ending: str) -> Column:
    return F.regexp_replace(x, ending, "")


def _first_change(x: Column, endings: list[str]) -> Column:
    """``x`` without the first of the endings that it has."""
    if not endings:
        return x
    return _once(_without(x, endings[0]), lambda y: F.when(y != x, y).otherwise(_first_change(x, endings[1:])))


def stem_ru(word: Column) -> Column:
    """The stem of a Russian word in small letters with ё written as е; null for null.

    Endings are looked for after the first vowel only; a word without one stays.
    """
    head = F.regexp_extract(word, f"^[^{VOWELS}]*[{VOWELS}]", 0)
    # From here on a noun's ost may go: after two times a vowel and a consonant.
    second = F.length(F.regexp_extract(word, f"^(?:.*?[{VOWELS}].*?[^{VOWELS}])" + "{2}", 0))

    def stem(front: Column) -> Column:
        body = F.substring(word, F.length(front) + 1, F.length(word))
        inflected = lambda b: _once(_without(b, _GERUND), lambda g: F.when(g != b, g).otherwise(_once(_without(b, "с[яь]$"), lambda r: _first_change(r, [_ADJECTIVE, _VERB, _NOUN]))))
        derived = lambda x: _once(_without(x, "ость?$"), lambda d: F.when((second > 0) & (F.length(front) + F.length(d) >= second), d).otherwise(x))
        single = lambda x: F.regexp_replace(x, "нн$", "н")
        tidied = lambda x: F.when(x.rlike("ейше?$"), single(_without(x, "ейше?$"))).when(x.rlike("нн$"), single(x)).otherwise(_without(x, "ь$"))
        out = _once(_once(body, inflected), lambda x: _once(derived(_without(x, "и$")), tidied))
        return F.when(front == "", word).otherwise(F.concat(front, out))

    return _once(head, stem)
