"""Candidates of the secret scan against a search character by character."""

from __future__ import annotations

import random
import re

import pytest

from thermoband.llm import secret_scan
from thermoband.llm.secret_scan import Candidate

TOKEN = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_~-")
#: The names in the order in which one that starts another is preferred.
NAMES = [
    "password", "passwd", "pass", "pwd", "secret", "token", "api_key", "api-key", "apikey", "access_key", "access-key", "accesskey",
    "authorization", "auth", "credential", "private_key", "private-key", "privatekey", "bearer",
]
#: Letters that count as another one (fixed values).
SAME = {"\u017f": "s", "\u0131": "i", "\u0130": "i", "\u212a": "k"}


def lower(text):
    return "".join(SAME.get(c) or (c.lower() if len(c.lower()) == 1 else c) for c in text)


def plain_tokens(text):
    out, i = [], 0
    while i < len(text):
        j = i
        while j < len(text) and text[j] in TOKEN:
            j += 1
        if j - i >= 16:
            end = j
            while end < len(text) and text[end] == "=" and end - j < 2:
                end += 1
            out.append((i, end))
        i = max(j, i + 1)
    return out


def blanks(text, i):
    while i < len(text) and text[i] in " \t":
        i += 1
    return i


def after_sign(text, i):
    """Ends of what stands between a name and its value, the preferred one first."""
    j = blanks(text, i)
    for sign in (":=", "=>", "===", "==", "=", ":"):
        if text.startswith(sign, j):
            yield blanks(text, j + len(sign))
    if j > i:
        yield j


def value_start(low, text, i):
    """Where the value of a name at i starts, if there is one."""
    for name in NAMES:
        if not low.startswith(name, i):
            continue
        end = i + len(name)
        for quote in ((1, 0) if text[end : end + 1] in ('"', "'") and end < len(text) else (0,)):
            for at in after_sign(text, end + quote):
                for more in ((1, 0) if at < len(text) and text[at] in "\"'" else (0,)):
                    begin = at + more
                    six = text[begin : begin + 6]
                    if len(six) == 6 and not any(c in "\"',;" or c.isspace() for c in six):
                        return begin
    return None


def plain_named(text):
    low, found, end, nested, i = lower(text), [], 0, False, 0
    while i < len(text):
        begin = value_start(low, text, i)
        if begin is None:
            i += 1
            continue
        if begin >= end:
            end, nested = begin, False
            while end < len(text) and text[end] not in "\"',;" and not text[end].isspace():
                end += 1
        elif nested:
            found.pop()
        else:
            nested = True
        found.append((begin, end))
        i = begin
    return found


def plain_candidates(text):
    named = set(plain_named(text))
    kept = []
    for c in sorted(set(plain_tokens(text)) | named, key=lambda c: (c[0], -c[1])):
        if not kept or c[1] > kept[-1][1] or c in named:
            kept.append(c)
    return kept


def made(rng):
    bits = [*NAMES, *(n.upper() for n in NAMES), "paſſword", "apı_key", "PRİVATE-KEY", "to\u212aen", "passphrase", "key"]
    bits += [" ", "  ", "\t", "=", "==", "====", ":", ":=", "=>", '"', "'", ",", ";", "\n", "hunter2!x", "aB3$kLm9", "x" * 5, "y" * 6, "z" * 20, "A" * 16 + "==", "_", "-", "é", " ", "."]
    return "".join(rng.choice(bits) for _ in range(rng.randint(1, 14)))


def test_candidates_on_made_texts():
    rng = random.Random(8)
    for _ in range(20_000):
        text = made(rng)
        assert secret_scan.candidates(text) == [Candidate(*c) for c in plain_candidates(text)], repr(text)


def test_candidates_on_documents(documents):
    texts = [r.text for r in documents.select("text").collect() if r.text]
    for text in texts:
        assert secret_scan.candidates(text) == [Candidate(*c) for c in plain_candidates(text)]


def test_the_quick_look_leaves_nothing_out():
    """Texts in which the pattern finds a name pass the quick look, in whatever case its letters are."""
    rng = random.Random(9)
    variants = {"s": "sS\u017f", "i": "iI\u0131\u0130", "k": "kK\u212a"}
    pattern = re.compile(rf"(?i:{secret_scan.NAMES})")
    for name in NAMES:
        for _ in range(60):
            text = "".join(rng.choice(variants.get(c, c + c.upper())) for c in name)
            assert pattern.search(text) and secret_scan.may_name(f"é {text} "), text
    assert not secret_scan.may_name("nothing of this kind") and not secret_scan.may_name("")


@pytest.mark.parametrize("text", ["", "=", "password", "password:", "token=" * 3, "password=      ", "a" * 15, "a" * 16, "pass pass pass pass word12"])
def test_edges(text):
    assert secret_scan.candidates(text) == [Candidate(*c) for c in plain_candidates(text)]
