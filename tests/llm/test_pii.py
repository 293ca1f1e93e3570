import re

import pytest
from hypothesis import given, settings, strategies as st

from samewise.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    return {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))],
        "phone": [m.span() for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15],
    }


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab@.-+ 0123456789()é", max_size=60))
def test_base_is_the_patterns(text):
    assert pii.base_spans(text) == plain(text)


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("mail bob [at] corp [dot] com now", "email", "bob [at] corp [dot] com"),
        ("mail bob at corp dot co dot uk now", "email", "bob at corp dot co dot uk"),
        ("bоb@corp.com", "email", "bоb@corp.com"),
        ("call plus four four two zero seven nine four six zero nine five eight ok", "phone", "plus four four two zero seven nine four six zero nine five eight"),
        ("card ４５３９１４８８０３４３６４６７", "card", "４５３９１４８８０３４３６４６７"),
        ("at 10(dot)0(dot)0(dot)1", "ip", "10(dot)0(dot)0(dot)1"),
    ],
)
def test_disguises(text, kind, span):
    found = [(k, text[s:e]) for s, e, k in pii.all_spans(text)[1]]
    assert (kind, span) in found


@pytest.mark.parametrize("text", ["look at the dot here", "we met at noon", "one two three", "", "plain words only", "(at) [dot]", "the dot at dot com dot x"])
def test_clean_texts_stay(text):
    base, spans = pii.all_spans(text)
    assert not any(base.values())
    assert not [s for s in spans if s[2] != "email"]


def test_offsets_and_order():
    text = "é a@b.co, 4539 1488 0343 6467, +44 20 7946 0958, 10.0.0.1"
    base, spans = pii.all_spans(text)
    assert [k for _, _, k in spans] == ["email", "card", "phone", "ip"]
    assert [text[s:e] for s, e, _ in spans] == ["a@b.co", "4539 1488 0343 6467", "+44 20 7946 0958", "10.0.0.1"]
    assert pii.redact(text) == "é <EMAIL>, <CARD>, <PHONE>, <IP>"


def test_linear_on_long_texts():
    for t in ("a" * 200_000, "1" * 200_000, "a@" * 50_000, "+1 " * 50_000, "1." * 50_000, "at dot " * 30_000):
        pii.all_spans(t)


def test_frames(spark, tricky, nothing):
    rows = pii.personal_data(tricky).collect()
    assert len(rows) == tricky.count() and all(len(r.spans) >= len(r.base) for r in rows)
    out = pii.redacted(tricky)
    assert out.columns == tricky.columns and out.count() == tricky.count()
    assert out.where("text is null").count() == 2
    assert pii.personal_data(nothing).count() == 0


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("call plus four four two two eight six four two six eight two ok", "phone", "plus four four two two eight six four two six eight two"),
        ("ring +44 two zero seven nine four six 0958 now", "phone", "+44 two zero seven nine four six 0958"),
        ("host one nine two dot one six eight dot one dot one up", "ip", "one nine two dot one six eight dot one dot one"),
    ],
)
def test_spelled_digits(text, kind, span):
    assert (kind, span) in [(k, text[s:e]) for s, e, k in pii.all_spans(text)[1]]


def test_planted_disguises_are_found():
    import random

    rng = random.Random(5)
    prose = ["the", "un", "der", "los", "at", "dot", "seven", "plain", "word", "été", "im", "six", "nada", "(see", "below)", "8", "huit", "acht", "null"]
    names = [list("zero one two three four five six seven eight nine".split()), list("zéro un deux trois quatre cinq six sept huit neuf".split()), list("null eins zwei drei vier fünf sechs sieben acht neun".split()), list("cero uno dos tres cuatro cinco seis siete ocho nueve".split())]
    looks = str.maketrans("aeopcxABEKMHOPCTX", "аеорсхАВЕКМНОРСТХ")

    def card():
        d = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        return next(d + c for c in "0123456789" if pii.luhn(d + c))

    found = {}
    for _ in range(600):
        user, host, end = rng.choice(["bob", "max.cope", "PACE"]), rng.choice(["corp", "mail-x", "EXACT"]), rng.choice(["com", "co.uk"])
        digits = "44" + "".join(rng.choice("0123456789") for _ in range(9))
        a, d = rng.choice([("[at]", "[dot]"), (" (at) ", " (dot) "), ("{at}", "{dot}"), (" arobase ".join("()"), " point ".join("()")), (" at ", " dot ")])
        cases = [
            ("email", "spelled", f"{user}{a}{host}{d}{end.replace('.', d)}"),
            ("email", "glyphs", f"{user}@{host}.{end}".translate(looks)),
            ("phone", "spelled", "plus " + " ".join(rng.choice(names)[int(c)] for c in digits) if rng.random() < 0.5 else "plus " + " ".join((n := rng.choice(names))[int(c)] for c in digits)),
            ("card", "wide", "".join(chr(0xFF10 + int(c)) for c in card())),
            ("ip", "dotted", "(dot)".join(str(rng.randrange(256)) for _ in range(4))),
        ]
        kind, how, secret = rng.choice(cases)
        before, after = (" ".join(rng.choices(["the", "plain", "word", "été", "nada", "below)"], k=8)) for _ in range(2))
        text = f"{before} {secret} {after}"
        spans = [(k, text[s:e]) for s, e, k in pii.all_spans(text)[1]]
        hits = found.setdefault((kind, how), [0, 0])
        hits[(kind, secret) in spans] += 1
    assert len(found) == 5
    for key, (no, yes) in found.items():
        assert yes / (no + yes) >= 0.9, (key, no, yes)


def test_words_of_clean_prose_stay():
    for t in ["un deux trois soleil", "null und acht Uhr", "dos y tres", "from six to nine", "А О К", "sept huit neuf dix", "seven of nine at dot"]:
        assert pii.all_spans(t)[1] == []


def test_upper_case_homoglyphs():
    text = "write to АЕОРС@еxample.com today"
    assert [text[s:e] for s, e, _ in pii.all_spans(text)[1]] == ["АЕОРС@еxample.com"]
