"""Secrets of any length, and values on the line after their name, are masked whole."""

import random

import pytest

from kelpline.llm import credentials as cr

R = random.Random(3)
ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def rnd(n):
    return "".join(R.choice(ALNUM) for _ in range(n - 1)) + "7"


LONG = rnd(6_000)
CASES = {
    "url": ("u = 'https://oauth2:", rnd(480), "@host.example/x'"),
    "url of a long user": (f"u = 'https://{rnd(600)}:", rnd(40), "@host.example/x'"),
    "bearer": ("Authorization: Bearer ", LONG, "\n"),
    "jwt": ("t('", f"eyJ{rnd(20)}.{LONG}.{rnd(40)}", "')"),
    "pypi": ("# ", "pypi-" + LONG, " x"),
    "next line": ("const apiKey =\n    '", rnd(40), "';"),
    "next line, crlf and blanks": ("apiKey: " + " " * 200 + "\r\n\r\n\t\"", rnd(40), "\","),
    "next argument": ("setenv('API_KEY',\n       '", rnd(40), "')"),
}


@pytest.mark.parametrize("name", CASES)
def test_masked_whole(name):
    before, secret, after = CASES[name]
    text = before + secret + after
    (spans,) = cr.find_all([text])
    assert [text[lo:hi] for lo, hi, _ in spans] == [secret]
    assert cr.mask(text, spans) == f"{before}REDACTED_{spans[0][2].upper()}{after}"


def test_next_line_only_for_literals():
    assert cr.find_all([f"secret:\n  name: {rnd(30)}\n", f"token = x\n'{rnd(30)}'", f"class Token:\n    'The value of {rnd(30)}.'"]) == [[], [], []]


def test_many_urls_and_anchors_stay_linear():
    text = "https://a.example/x Bearer eyJ ghp_ sk- " * 20_000
    assert cr.find_all([text]) == [[]]


@pytest.mark.parametrize(
    "before,secret,after",
    [("curl -u ci:", "kcXsHZCvps89Fu", " https://a.example/x"), ("curl --user 'ci:", "kcXsHZCvps89Fu", "' https://a.example"), ("mysql -u root -p", "Jg4SFB85dyru", " db < dump.sql"), ("// staging pw is ", "SCO!5vwnebb2nQ7", " until then"), ('  "ldapBindPw": "', "3tloICsIt3!6S5j", '",'), ("PASSWD=", "ocIQSTbtem!LJMa", "")],
)
def test_logins_of_commands_and_notes(before, secret, after):
    text = before + secret + after
    (span,) = cr.find_all([text])[0]
    assert text[span[0] : span[1]] == secret


@pytest.mark.parametrize("text", ["curl -u $USER:$PASS https://a.example", "mkdir -p build/output-2024", "docker run -p 8080:8080 image", "ssh -p 2222 host", "the token is read before use", "curl -u user https://a.example/x1", "sort -u file:name"])
def test_flags_that_hold_no_login(text):
    assert cr.find_all([text]) == [[]]
