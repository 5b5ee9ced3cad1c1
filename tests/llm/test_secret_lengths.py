"""No length of a literal, of a name or of the blanks around the operator hides a secret."""

import time

import pytest

from corpuswright.llm import secret_scan

VALUE = "Zx81-qqPw0-rTT4"


@pytest.mark.parametrize(
    "text, value",
    [
        (f'private_key = "{VALUE * 400}"', VALUE * 400),
        (f"db_password = '{VALUE * 10_000}'", VALUE * 10_000),
        (f'db_password{" " * 20}={" " * 20}"{VALUE}"', VALUE),
        (f'db_password\t=\t"{VALUE}"', VALUE),
        (f'{"a_" * 100}password = "{VALUE}"', VALUE),
        (f'db_password = "{VALUE}"{" " * 12}+\t"{VALUE}"', f'{VALUE}"{" " * 12}+\t"{VALUE}'),
    ],
)
def test_no_length_hides_a_secret(text, value):
    assert [text[s:e] for s, _, e in secret_scan.literal_spans(text)] == [value]


def test_long_runs_take_linear_time():
    for text in ("a" * 500_000, "a=" + " " * 500_000, 'a="' + "x" * 500_000, 'a="x ' * 100_000, "a= '" * 100_000):
        secret_scan.literal_spans(text)


def test_blanks_and_blocks_take_little_time():
    texts = ("a: b" + " " * 1_000_000, "a: b" + " c" * 300_000, " a: |\n" * 100_000, "".join(" " * k + "password: |\n" for k in range(700)))
    for text in texts:
        begun = time.monotonic()
        secret_scan.literal_spans(text)
        assert time.monotonic() - begun < 5


def test_the_inner_of_two_blocks_is_the_literal():
    text = "config: |\n  password: |\n    Zx81-qqPw0-rTT4\n  other: 1\npassword: |\nnot indented\n"
    assert [text[s:e].strip() for s, _, e in secret_scan.literal_spans(text)] == ["Zx81-qqPw0-rTT4"]
