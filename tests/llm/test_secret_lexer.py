"""What the assignment lexer adds to the base patterns: planted values in many syntaxes, and what must not be found."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuswright.llm import secret_scan

V = "Zx81-qqPw0-rTT4"


def found(text):
    return [text[s:e] for s, _, e in secret_scan.literal_spans(text)]


@pytest.mark.parametrize(
    "text",
    [
        'db_pwd = BASE\nBASE = "{}"', 'a=b\nb=c\nc=a\npassword=a\nb="{}"', 'dbpassword\t=\t"{}"', 'password: str = "{}"', 'let password: String = "{}";',
        'cfg["password"] = "{}"', 'password = os.getenv("PW", "{}")', "<password>{}</password>", '<add key="password" value="{}"/>', "run --password {} now",
        'put("password", "{}")', 'password = """\n{}\n"""', "export DB_PASSWORD={}", '$db_password = "{}";', '"password" : "{}",', 'secret = a.b("{}")',
        'password = (\n   "{}"\n)', "encryption_key = '{}'", 'tokens: ["{}"]', "a=1&password={}", 'URL_SECRET = "x${{PW}}"\nPW="{}"', "password: {}", "private_key: |\n  {}\nnext: 1",
    ],
)
def test_syntaxes(text):
    assert V in [x.strip() for x in found(text.format(V))]


@pytest.mark.parametrize(
    "text",
    [
        "Then he said the password: something else.", "token: something", f'colour = "{V}"', f'tokenizer = "{V}"', 'password_hint = "your first pet name"', 'password = "changeme"',
        'password = "${DB_PASSWORD}"', 'secret = "<your secret>"', 'token_url = "https://example.com/oauth/token"', "password = None", 'password = get("DB_PASSWORD_VALUE")', "secret == other_value_1",
    ],
)
def test_prose_and_placeholders(text):
    assert found(text) == []


def test_all_items_and_parts():
    assert found(f'secrets = ["{V}", "{V[::-1]}"]') == [V, V[::-1]]
    assert found(f'db_pwd = BASE + "x9"\nBASE = "{V}"') == ["x9", V]
    assert found(f'db_pwd = "x9" + "{V}"') == [f'x9" + "{V}']
    assert found(f'one = "{V}"\ntwo = "{V}2"\npassword = two')[0] == V + "2"


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcXYZ0189+/=-_!%", min_size=12, max_size=60).filter(lambda v: len(set(v)) > 7), st.text(alphabet='ab ="\':\n{}[]()<>+.,$`\\\\', max_size=40), st.sampled_from(['"', "'"]))
def test_a_quoted_value_on_its_own_line_is_found(value, before, quote):
    """Whatever stands on the lines before (unless it opens a literal of several lines), the planted literal is found as it is."""
    if "`" in before or '""' in before or "''" in before or before.rstrip(" ").endswith(("\\", "|", ">", "+", ".", "=", ":", "&")):
        before = ""
    text = f"{before}\n;\npassword = {quote}{value}{quote}\n"
    at = text.rindex(value)
    assert (at, 3, at + len(value)) in secret_scan.literal_spans(text, threshold=0.7)


@given(st.text(alphabet="ab =:'\"\n{}[]()<>+.,$`\\\\&|-#\t0"))
@settings(max_examples=300, deadline=None)
def test_spans_lie_in_the_text(text):
    for s, k, e in secret_scan.literal_spans("password=" + text, threshold=-2):
        assert 0 <= s <= e <= len(text) + 9 and k == 3


def test_odd_texts_take_linear_time():
    for text in ('"' * 20000, "a=b+" * 20000, "x=(" * 20000, "<a>" * 20000, "a:b " * 20000, "p=`" * 20000, "secret=f(" * 5000, "password=b+" * 20000, 'password = "a" + x + ' * 5000, "password=a\n" * 20000):
        secret_scan.literal_spans(text)
