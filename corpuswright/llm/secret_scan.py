"""Secret scanning by assignment-aware lexing.

Three base patterns find spans wherever they stand. On top of them a lexer reads a text as source or configuration. It finds
name-literal pairs (`name = "x"`, `"name": "x"`, `name => 'x'`, `name: type = "x"`, `export NAME=x`, `--name x`, `cfg["name"] = "x"`,
`put("name", "x")`, `<name>x</name>`, `key="name" value="x"`, YAML blocks), each with the expression on its right: string
literals of any length, in one line or several, joined by operators or put next to each other, names, and calls around them.

Constants are propagated to a fixed point over all bindings of the text, wherever they stand: what a sensitive name is
assigned hands the name's weight on to the names in its expression, and so on. Each literal is scored by the largest weight
that reaches it and by its own looks; literals that score at least `threshold` become `literal` spans.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import DataFrame

from .common import text_rows

KINDS = ("assign", "access", "hex", "literal")
#: Letters of the names in either case, spelt out so that no other character folds to them.
_ANY = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
_NAMES = "|".join(map(_ANY, ("password", "passwd", "secret", "token"))) + "|" + _ANY("api") + "_?" + _ANY("key")
ASSIGN = re.compile(rf"({_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")

#: What the words of a name are worth; the best one counts.
NAME_WEIGHTS = {
    "password": 0.7, "passwd": 0.7, "pwd": 0.65, "pass": 0.5, "passphrase": 0.7, "secret": 0.65, "token": 0.6, "credential": 0.65, "cred": 0.6,
    "apikey": 0.7, "api": 0.3, "key": 0.35, "auth": 0.45, "bearer": 0.55, "jwt": 0.55, "private": 0.4, "signature": 0.4, "salt": 0.4, "dsn": 0.4, "pin": 0.35,
}
#: Words that make a key a secret one, and words that say that a name holds something about a secret, not the secret.
_KEY_OF = {"api", "private", "access", "secret", "encryption", "encrypt", "signing", "sign", "master", "auth", "ssh", "storage", "account", "shared", "service", "app", "client"}
_ABOUT = set(
    "url uri path file filename name field label type length id hint placeholder prompt message error endpoint header regex pattern class column table "
    "count limit size ttl expiry expires timeout policy help title description".split()
)
_STEM = re.compile(
    r"(?:^|.)(password|passwd|passphrase|pwd|secret|token|credential|apikey)s?$|^(password|passwd|passphrase|pwd|secret|token|credential|apikey)(?:s|key|hash|value|file|url|id|name)?$"
)
_KEYWORDS = {"return", "if", "else", "elif", "case", "when", "default", "true", "false", "none", "null", "nil", "new", "not", "and", "or", "await", "lambda"}
_STRING = (
    r'(?:[rRuUbBfF]{0,2}(?:"""(?P<d3>(?:[^"\\]++|\\.|"(?!""))*+)"""|\'\'\'(?P<s3>(?:[^\'\\]++|\\.|\'(?!\'\'))*+)\'\'\''
    r'|"(?P<d1>(?:[^"\\\n]++|\\.)*+)"|\'(?P<s1>(?:[^\'\\\n]++|\\.)*+)\'|`(?P<b1>(?:[^`\\]++|\\.)*+)`))'
)
_TERM = re.compile(rf"{_STRING}|(?P<ref>\$?[A-Za-z_][\w.]*+)(?P<call>\((?!\)))?", re.S)
_ARGUMENT = re.compile(rf"\s*+(?:(?P<comma>,)|{_STRING}|(?P<other>[^\s,()\"'`]++))", re.S)
_JOIN = re.compile(r"[ \t]*+(?:\\?\n[ \t]*+)?(?:\+|\.{1,2}|\|\||&)[ \t]*+(?:\\?\n[ \t]*+)?(?=[\"'`$A-Za-z_])|\s*+(?=[\"'`])")
_PAIR = re.compile(
    r"""(?<![\w.$])(?:(?P<flag>--)|(?P<q>["'`])?)(?P<name>[$@]?[A-Za-z_][\w.\-]*+)(?(q)(?P=q)(?:[ \t]*+\])?)
    (?:[ \t]*+(?P<op>:=|=>|=|:)(?![=/~:])[ \t]*+|(?(flag)[ \t]++(?!-)|(?!)))(?:[(\[]\s*+)?""",
    re.X,
)
_CALLED = re.compile(rf"[(,]\s*+([\"'])(?P<name>[A-Za-z_][\w.\-]*+)\1\s*+,\s*+(?=[\"'`])")
_ELEMENT = re.compile(r"<(?P<name>[A-Za-z_][\w.\-]*+)(?:\s[^<>]*+)?>\s*+(?P<value>[^<>\s][^<>]*+)</(?P=name)\s*>")
_ATTRIBUTE = re.compile(r"\b(?:key|name)\s*+=\s*+([\"'])(?P<name>[A-Za-z_][\w.\-]*+)\1\s++value\s*+=\s*+(?=[\"'])")
_BARE = re.compile(r"[^\s\"'`,;(){}\[\]<>|]+")
_COMMA = re.compile(r"\s*+,\s*+(?=[\"'`])")
_DIGIT = re.compile(r"\d")
_HEAD = re.compile(r"[|>][+-]?[ \t]*+\n(?P<indent>[ \t]++)")
_BLOCK = re.compile(r"[|>][+-]?[ \t]*\n(?P<body>(?P<indent>[ \t]+)[^\n]*(?:\n(?P=indent)[^\n]*|\n[ \t]*(?=\n))*)")
_ANNOTATED = re.compile(r"[A-Za-z_][\w.\[\]<>|?& ]*+[ \t]*+=(?![=>])[ \t]*+")
_BLANKS = re.compile(r"[ \t]*+")
_INSIDE = re.compile(r"\$\{?([A-Za-z_]\w*+)|\{([A-Za-z_][\w.]*+)\}|%([A-Za-z_]\w*+)%")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_PLACEHOLDER = re.compile(r"(?i)^(?:none|null|true|false|changeme|change[_-]?me|example|x{3,}|\*+|\.+|<.*>|todo.*|your[_-].*|\$\{?\w+\}?|%\w+%|\{\{.*\}\}|(.)\1*)$", re.S)


def name_score(name: str) -> float:
    words = [w.lower() for w in _WORDS.findall(name)]
    best = 0.0
    for w in words:
        stem = _STEM.search(w)
        best = max(best, NAME_WEIGHTS.get(w, 0.0), NAME_WEIGHTS.get(w.rstrip("s"), 0.0), NAME_WEIGHTS[stem[1] or stem[2]] if stem else 0.0)
    if ("key" in words or "keys" in words) and _KEY_OF & set(words):
        best = 0.7
    return best / 2 if words and words[-1] in _ABOUT else best


def literal_score(value: str) -> float:
    """0 to 0.5 by kinds of characters, entropy a character and the mixture of letters with digits; -1 if it cannot be a secret."""
    if len(value) < 8 or _PLACEHOLDER.match(value):
        return -1.0
    counts = Counter(value)
    entropy = -sum(c / len(value) * math.log2(c / len(value)) for c in counts.values())
    lower, upper, digit = (any(map(f, counts)) for f in (str.islower, str.isupper, str.isdigit))
    kinds = lower + upper + digit + any(not c.isalnum() for c in counts)
    mixed = 0.12 if len(value) >= 16 and digit and (lower or upper) and " " not in value else 0.0
    prose = 0.2 if " " in value.strip() and "-----BEGIN" not in value else 0.0
    link = 0.3 if re.match(r"(?:[a-z]+:/)?/", value) and "@" not in value else 0.0
    return min(0.5, 0.05 * kinds + 0.05 * entropy + mixed) - prose - link


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, order of the kind, end) of what the three base patterns find."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _inner(m: re.Match) -> tuple[int, int] | None:
    """Where the literal of a match stands, without its quotes."""
    for g in ("d3", "s3", "d1", "s1", "b1"):
        if m.span(g) != (-1, -1):
            return m.span(g)
    return None


def _call(text: str, at: int, callee: str) -> tuple[list[tuple[int, int]], int]:
    """The last literal among a call's first arguments: what is wrapped, or the default of a look-up."""
    literals, n = [], 1
    while m := _ARGUMENT.match(text, at):
        at = m.end()
        if m["comma"]:
            n += 1
        elif span := _inner(m):
            literals = [(n, span)]
    asks = re.search(r"(?i)get|env|find|lookup|read|fetch|load", callee)
    return [s for k, s in literals if k > 1 or not asks], at


def _expression(text: str, at: int) -> tuple[list, int]:
    """The terms from a place on, (start, end) of literals and the names of constants in turn; and where they end."""
    terms: list = []
    while m := _TERM.match(text, at):
        if span := _inner(m):
            terms.append(span)
            terms += [next(filter(None, x.groups())) for x in _INSIDE.finditer(text, *span)] if any(c in "${%" for c in text[span[0] : span[1]]) else []
            at = m.end()
        elif m["ref"].lower() in _KEYWORDS:
            break
        elif m["call"]:
            wrapped, at = _call(text, m.end(), m["ref"])
            terms += wrapped
        else:
            terms.append(m["ref"].lstrip("$"))
            at = m.end()
        join = _JOIN.match(text, at)
        if not join or (join.end() == at and not terms) or (not text[at : join.end()].strip() and not isinstance(terms[-1] if terms else "", tuple)):
            break
        at = join.end()
    return terms, at


def _indent(text: str, at: int) -> int:
    """How far the line of a place is indented."""
    line = text.rfind("\n", 0, at) + 1
    return _BLANKS.match(text, line, at).end() - line


def bindings(text: str) -> dict[str, list[tuple[list, bool]]]:
    """What each name of a text is bound to: expressions, and whether they stand there without quotes."""
    out: dict[str, list[tuple[list, bool]]] = defaultdict(list)
    bare_values, run_end, first = [], -1, True
    outer, block_end = [], -1
    for m in _PAIR.finditer(text):
        at, op = m.end(), m["op"] or " "
        if op == ":" and (typed := _ANNOTATED.match(text, at)):
            at = typed.end()
        # a block is indented further than its name, so blocks nest no deeper than the root of the text's length; one that holds
        # another is structure, and no literal
        if op == ":" and (head := _HEAD.match(text, at)) and len(head["indent"]) > _indent(text, m.start()):
            block = _BLOCK.match(text, at)
            if m.start() < block_end:
                outer.clear()
            outer, block_end = [block.span("body")], block.end()
            out[m["name"]].append((outer, False))
            continue
        terms, end = _expression(text, at)
        if at >= run_end:
            bare = _BARE.match(text, at)
            run_end, first = (bare.end() if bare else at), True
        quoted = any(isinstance(t, tuple) for t in terms)
        if run_end > max(end, at) and not quoted:
            terms = []  # not a name, but text without quotes
        name = m["name"].lstrip("$@")
        if terms:
            out[name].append((terms, False))
        while quoted and m[0].rstrip().endswith("[") and (comma := _COMMA.match(text, end)):  # the other items of a list
            terms, end = _expression(text, comma.end())
            out[name].append((terms, False))
        if run_end > at and not quoted:
            prose = op in (":", "=>", " ")  # may be a word of prose
            bare_values.append((name, m.start(), at, run_end, first, prose))
            first = False
    for (name, _, at, end, first, prose), after in zip(bare_values, bare_values[1:] + [(None, len(text), 0, 0, True, False)]):
        if not first:  # one text without blanks may hold several pairs: only its first has all of it
            end = min(end, after[1])
        while end > at and text[end - 1] in ".,":
            end -= 1
        if end > at and not (prose and not _DIGIT.search(text, at, end)):
            out[name].append(([(at, end)], True))
    for pattern in (_CALLED, _ATTRIBUTE):
        for m in pattern.finditer(text):
            if terms := _expression(text, m.end())[0]:
                out[m["name"]].append((terms, False))
    if "</" in text:
        for m in _ELEMENT.finditer(text):
            out[m["name"]].append(([m.span("value")], False))
    return out


def _weights(bound: dict[str, list[tuple[list, bool]]]) -> dict[str, float]:
    """The fixed point: a name weighs what its own words say, or what a name weighs whose expression has it, if that is more."""
    weight = {n: name_score(n) for n in bound}
    todo = sorted((n for n in weight if weight[n] > 0), key=weight.get)
    while todo:
        name = todo.pop()
        for terms, _ in bound[name]:
            for ref in (t for t in terms if isinstance(t, str)):
                for known in {ref, ref.rsplit(".", 1)[-1]} & weight.keys():
                    if weight[known] < weight[name]:
                        weight[known] = weight[name]
                        todo.append(known)
    return weight


def _runs(text: str, terms: list) -> list[tuple[int, int, str]]:
    """Literals of an expression, those without a name between them as one."""
    out: list[list] = []
    last = None
    for t in terms:
        if isinstance(t, tuple):
            value = text[t[0] : t[1]]
            if isinstance(last, tuple):
                out[-1][1:] = [t[1], out[-1][2] + value]
            else:
                out.append([t[0], t[1], value])
        last = t
    return [tuple(r) for r in out]


def _whole(text: str, terms: list, bound: dict, most: int = 64) -> str:
    """A value with the constants that it names, each once, until there is enough of it to judge."""
    out, seen, todo = "", set(), list(terms)
    while todo and len(out) < most:
        t = todo.pop(0)
        if isinstance(t, tuple):
            out += text[t[0] : t[1]]
        elif t not in seen and t in bound:
            seen.add(t)
            todo = bound[t][0][0] + todo  # what the name is bound to first
    return out


def literal_spans(text: str, threshold: float = 0.8) -> list[tuple[int, int, int]]:
    """(start, 3, end) of each literal which reaches a sensitive name directly or by constants."""
    if not any(c in text for c in "=:(<") and "--" not in text:
        return []
    bound = bindings(text)
    weight = _weights(bound)
    found: dict[tuple[int, int], float] = {}
    for name, held in bound.items():
        if not weight[name]:
            continue
        for terms, bare in held:
            for start, end, value in _runs(text, terms):
                look = literal_score(value)
                if len(value) < 8 and not bare and any(isinstance(t, str) for t in terms):
                    look = literal_score(_whole(text, terms, bound))  # part of a value that constants complete
                if look > -1 and value.strip():
                    found[start, end] = max(found.get((start, end), 0.0), weight[name] + look)
    return sorted((s, 3, e) for (s, e), score in found.items() if score >= threshold - 1e-9)


def _spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan(text: str, threshold: float = 0.8) -> tuple[int, int, int, int, str, str]:
    base = base_spans(text)
    more = literal_spans(text, threshold)
    n = Counter(k for _, k, _ in base)
    return n[0], n[1], n[2], len(more), _spell(base), _spell(base + more)


def find_secrets(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_literal, base_spans and spans of every text: `kind:start:end`, comma-joined, by start.

    Offsets count code points, the end is exclusive. Null and empty texts give zeros and empty strings; repeated rows give a
    row each; an empty table an empty result. Literals, names and blanks of any length are read. Rows never meet, so nothing
    shuffles, whatever the size or skew.
    """

    def run(batches):
        for b in batches:
            rows = [scan(t, threshold) for t in b["text"]]
            out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "n_literal", "base_spans", "spans"])
            out.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield out

    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_literal long, base_spans string, spans string"
    return text_rows(docs).mapInPandas(run, schema)
