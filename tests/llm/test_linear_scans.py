"""Secret candidates and spelled-out addresses: plain specifications, texts without white space, time that follows length."""

import random
import re
import time

import pytest

from skyloom.llm import pii, secrets

CUE = re.compile("(?:" + "|".join(secrets.FOR) + r")[a-z0-9_.-]{0,40}[\"'`\])]{0,2}[ \t]{0,8}\Z")
END = re.compile(r"[\s\x00-\x1f\x7f]")


def plain_values(text):
    """Values behind cue words, each looked at on its own."""
    signs = [m.span() for m in secrets.SIGN.finditer(text) if CUE.search(text[max(0, m.start() - 64) : m.start()].lower())]
    signs = sorted({*signs, *(m.span() for m in secrets.BEARER.finditer(text))})
    out = set()
    for k, (start, a) in enumerate(signs):
        limit = signs[k + 1][0] if k + 1 < len(signs) else len(text)
        if text[a : a + 1] in ('"', "'", "`"):
            close = text.find(text[a], a + 1)
            a += 1
            if close > a and not END.search(text[a:close]):
                out.add((a, close))
                continue
        b = a
        while b < limit and not END.match(text[b]) and text[b] not in ",;}\"'`" and not re.match(r"&[A-Za-z_][A-Za-z0-9_.-]{0,40}=", text[b:limit]):
            b += 1
        if "&" in text[a + 1 : b] and text[a : a + 1] != "&" and "?" in text[max(0, start - 40) : a]:
            b = text.index("&", a)
        while b > a and text[b - 1] in ".,;:)]}>\"'`":
            b -= 1
        if a < b:
            out.add((a, b))
    return out


def test_values_against_plain_specification():
    r = random.Random(21)
    parts = ["token", "key", "secret", "pass", "word", "name", "id", ":", "=", '"', "'", ",", ";", "}", "{", "&", "?", " ", "\n", "a", "Zx9", "bearer ", "...", ")", "_", "==", "\\", "é"]
    for _ in range(30_000):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 24)))
        assert set(secrets._values(text)) == plain_values(text), text


def test_minified_texts():
    forest = secrets.default_forest()
    clean = (
        '"auth":false,"id":7,"name":"Ann","city":"Rome","zip":"00100"',
        '{"token":null,"text":"hello-world","x":[1,2,3],"author":"me"}',
        "var token=e.token,key=t.key;return",
        'k="secret";n.auth=function(e){return e}',
    )
    assert [secrets.scan_text(forest, t)[1] for t in clean] == [[]] * len(clean)
    for text, secret in (('{"id":1,"api_key":"Zx81kQpL09vBn3MtY7","b":1}', "Zx81kQpL09vBn3MtY7"), ("a?api_key=abcDEF123456ghi&x=1", "abcDEF123456ghi"), ('t="24be64439e3e49cf46b2d7c90f3602a3d0b907ff",token="24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "24be64439e3e49cf46b2d7c90f3602a3d0b907ff")):
        found = secrets.scan_text(forest, text)[1]
        assert secret in [text[x.start : x.end] for x in found] and all(text[x.start : x.end] == secret for x in found)


@pytest.mark.parametrize("unit", ["token:a,", 'token:"a', "token=", "bearer ", "a=b&token=x", '"key":"v","secret":1,'])
def test_secret_scans_take_linear_time(unit):
    forest = secrets.default_forest()
    began = time.time()
    secrets.scan_text(forest, unit * ((1 << 20) // len(unit)))
    assert time.time() - began < 20


def test_spelled_addresses_against_one_pattern():
    whole = re.compile(r"(?i)[\s\[({<]at[\s\])}>].*(?:\.|[\s\[({<]dot[\s\])}>])[\s]*[a-z]", re.S)
    r = random.Random(3)
    for _ in range(20_000):
        text = "".join(r.choice(["a", " at ", "[at]", " dot ", ".", "[dot]", " ", "b", "(at)", "1"]) for _ in range(r.randint(1, 9)))
        assert bool(whole.search(text)) == pii.spelled(text)


def test_trimming_against_plain_loop():
    def plain(text):
        a, b = 0, len(text)
        while a < b and text[a] in pii.EDGE and not (text[a] in "(" and ")" in text[a:b]):
            a += 1
        while a < b and text[b - 1] in pii.EDGE and not (text[b - 1] in ")" and "(" in text[a:b]):
            b -= 1
        return a, b

    r = random.Random(4)
    for _ in range(20_000):
        text = "".join(r.choice("().,a[]") for _ in range(r.randint(0, 9)))
        assert plain(text) == pii._trim(text, 0, len(text))


@pytest.mark.parametrize("unit", ["[at]", "bob at home ", "((((1", "bob [at] ex [dot] com, "])
def test_personal_data_takes_linear_time(unit):
    model = pii.default_model()
    began = time.time()
    pii.find(model, [unit * ((1 << 20) // len(unit))])
    assert time.time() - began < 30
