"""Surrogates: what is found, that mentions stay together and entities apart, and the query against plain Python."""

import duckdb
import pytest
import regex

from corpuswright.llm import queries, surrogates

SF = "/root/testdata/sf0.01"


def replaced(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in sorted(queries.replace_personal_data(docs, "k").collect(), key=lambda r: r.doc_id)]


NAMES = [
    "Mr McDonald met Miss Smith-Jones. Herr Müller-Schmidt came.", "Mr O'Neil, Dr Ada Brown, MRS JANE DOE. Ada Brown's dog; Brown left; ADA too.", "Mrs. Jane Doe and Mrs Jane Doe. Ms Doe.",
    "Prof. Dr. J. K. van der Berg wrote. Berg here.", "Госпожа Анна Петрова и г-н Петров. Петрова ушла.", "my name is Grace Hopper. Grace is nice.", "Κύριος Νίκος Παπάς.",
]


def test_no_part_of_a_name_stays(spark):
    got = replaced(spark, NAMES)
    parts = "McDonald Donald Smith Jones Müller Schmidt Neil Ada Brown Jane Doe Berg Анна Петров Grace Hopper Νίκος Παπάς".lower().split()
    assert not [(p, t) for t in got for p in parts if p in t.lower()]
    assert got[0].startswith("Mr ") and "-" in got[0].split("Miss ")[1].split(".")[0]


def test_spellings_of_an_entity_stay_together(spark):
    got = replaced(spark, NAMES + [
        "+1 212-555-0100 or 212-555-0100 or (212) 555-0100", "+49 30 1234567 or 030 1234567", "card 4111 1111 1111 1111 = 4111111111111111",
        "DE89 3704 0044 0532 0130 00 = DE89370400440532013000 but not XY12ABCD5678", "2001:db8::1 = 2001:0db8:0:0:0:0:0:1", "Ann.Lee@mail.example.com ANN.LEE@MAIL.EXAMPLE.COM",
    ])
    full, short = regex.fullmatch(r"Mrs\. (\w+ (\w+)) and Mrs \1\. Ms (\w+)\.", got[2]).group(1, 3)
    assert full.split()[1] == short and full.upper() in got[1]
    first, last = regex.search(r"Dr (\w+) (\w+),", got[1]).groups()
    assert f"{first} {last}'s dog; {last} left; {first.upper()} too." in got[1]
    a, b = regex.fullmatch(r"Госпожа \w+ (\w+) и г-н (\w+)\. \1 ушла\.", got[4]).groups()
    assert regex.fullmatch(r"\p{IsCyrillic}+", a + b) and a != b
    one, two, three = regex.fullmatch(r"\+1 (\S+) or (\S+) or (.+)", got[7]).groups()
    assert one == two == three.replace("(", "").replace(") ", "-") != "212-555-0100"
    assert len({regex.sub(r"^\+49|^0|\D", "", x) for x in got[8].split(" or ")}) == 1
    x, y = got[9].removeprefix("card ").split(" = ")
    digits = [int(d) for d in reversed(y)]
    assert x.replace(" ", "") == y and sum(sum(divmod(d * (1 + i % 2), 10)) for i, d in enumerate(digits)) % 10 == 0
    x, y = got[10].split(" but not ")[0].split(" = ")
    assert x.replace(" ", "") == y and int("".join(str(int(c, 36)) for c in y[4:] + y[:4])) % 97 == 1 and got[10].endswith("XY12ABCD5678")
    assert len(set(got[11].split(" = "))) == 1 and got[12].split()[0].upper() == got[12].split()[1]


def test_more_names_than_a_short_name_has_room_for(spark):
    many = spark.range(0, 70_000).selectExpr("id AS doc_id", "concat('Mr ', initcap(translate(cast(id AS string), '0123456789', 'abcdefghij')), 'x left') AS text")
    got = queries.replace_personal_data(many, "k")
    assert tuple(got.selectExpr("count(DISTINCT text)", "min(n_entities)").first()) == (70_000, 1)


def test_odd_rows(spark):
    rows = [(None, "Mr Brown"), (1, None), (1, "Mr Brown"), (1, "Mr Brown"), (2, ""), (3, "Mr X." + " word" * 200_000 + " Mr Brown"), (4, "a@" + "b." * 3000 + "c")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, found string")
    got = queries.replace_personal_data(docs, "k").collect()
    assert len(got) == len(rows) and len({r.text for r in got if r.text[:3] == "Mr " and len(r.text) < 30}) == 1
    assert queries.replace_personal_data(docs.limit(0), "k").count() == 0


@pytest.fixture(scope="module")
def documents():
    return dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet'").fetchall())


def test_query(spark, documents):
    """Every span that the pattern finds in plain Python is replaced and nothing else; entities map one to one."""
    pattern = regex.compile(surrogates.ALL)
    known, back, originals = {}, {}, set()
    rows = queries.op8_personal_data(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(documents)
    for r in rows:
        text, at, n = documents[r.doc_id], 0, 0
        pieces = []
        for m in pattern.finditer(text):
            pieces.append((regex.escape(text[at : m.start()]), m[0]))
            at, n = m.end(), n + 1
        shape = "".join(a + "(" + regex.sub(r"\d", r"\\d", regex.escape(v)) + ")" if "@" not in v and not regex.search(r"\d\.\d", v) else a + r"(\S+)" for a, v in pieces) + regex.escape(text[at:])
        found = regex.fullmatch(shape, r.text)
        assert found and r.n_entities == n
        for (_, v), s in zip(pieces, found.groups()):
            kind = "email" if "@" in v else "ip" if regex.fullmatch(r"\d+(\.\d+){3}", v) else "number"
            form = (kind, v.lower() if kind != "number" else regex.sub(r"^\+1", "", regex.sub(r"[^\d+]", "", v)).lstrip("0"))
            new = (kind, s.lower() if kind != "number" else regex.sub(r"^\+1", "", regex.sub(r"[^\d+]", "", s)))
            assert known.setdefault(form, new) == new and back.setdefault(new, form) == form
            originals.add(form)
    assert len(known) > 20 and not originals & set(back)
