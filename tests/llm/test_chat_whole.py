"""op1_chat_format against plain Python: no conversation and no turn is lost, and sides part at any turn."""

import hashlib

import duckdb

from corpuswright.llm import chat_format, queries
from test_brute_force import SF


def _shown(turns):
    return "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns)


def _mask(turns):
    at, spans = 0, []
    for role, text in turns:
        begin = at + len(role) + 13
        end = begin + len(text) + 10
        if role == "assistant":
            spans.append(f"{begin}:{end}")
        at = end + 1
    return ",".join(spans)


def _want(conv_id, turns):
    answers = [k for k, (role, _) in enumerate(turns) if role == "assistant"]
    other = list(turns)
    if answers:
        k = answers[int(hashlib.md5(str(conv_id).encode()).hexdigest()[:8], 16) % len(answers)]
        other[k] = ("assistant", turns[0][1] if k else "")
    n = 0
    while n < len(turns) and turns[n] == other[n]:
        n += 1
    return n, _shown(turns[:n]), _shown(turns[n:]), _shown(other[n:]), _mask(turns[n:]), _mask(other[n:])


def test_whole_conversations(spark):
    told = {}
    sql = f"""SELECT conv_id, coalesce(role, 'user'), coalesce(text, '') FROM '{SF}/conversations.parquet' WHERE conv_id IS NOT NULL
              ORDER BY conv_id, turn NULLS FIRST, 2, 3"""
    for i, role, text in duckdb.sql(sql).fetchall():
        told.setdefault(i, []).append((role, text))
    rows = queries.op1_chat_format(spark, SF).collect()
    got = {r.conv_id: (r.n_prefix, r.prompt, r.chosen, r.rejected, r.chosen_mask, r.rejected_mask) for r in rows}
    assert len(rows) == len(told) and got == {i: _want(i, turns) for i, turns in told.items()}
    assert len({len(told[i]) - g[0] for i, g in got.items()}) > 2  # sides part early and late


def test_no_answer_and_tail_are_kept(spark):
    turns = spark.createDataFrame(
        [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "tail"), (2, 0, "user", "x"), (3, 0, "assistant", "y")],
        "conv_id long, turn long, role string, text string",
    )
    got = {r.conv_id: r for r in chat_format.format_pairs(chat_format.whole_pairs(turns), "conv_id").collect()}
    assert set(got) == {1, 2, 3}
    assert "tail" in got[1].chosen and "tail" in got[1].rejected
    assert got[2].prompt == "<|im_start|>user\nx<|im_end|>\n" and got[2].chosen == got[2].rejected == got[2].chosen_mask == ""
    assert got[3].n_prefix == 0 and got[3].rejected_mask == "22:32"


def test_two_tables_of_turns(spark):
    """Sides of one pair from two tables; a conversation on one side only makes no pair; very long turns are rendered whole."""
    schema = "conv_id long, turn long, role string, text string"
    long = "word " * 200_000
    a = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", long), (2, 0, "user", "only here"), (3, 0, "user", "same")], schema)
    b = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "short"), (1, 2, "user", "more"), (3, 0, "user", "same")], schema)
    got = {r.conv_id: r for r in chat_format.pair_conversations(a, b).collect()}
    assert set(got) == {1, 3} and got[1].n_prefix == 1 and got[1].prompt == _shown([("user", "q")])
    assert got[1].chosen == _shown([("assistant", long)]) and got[1].chosen_mask == f"22:{32 + len(long)}"
    assert got[1].rejected == _shown([("assistant", "short"), ("user", "more")]) and got[1].rejected_mask == "22:37"
    assert (got[3].n_prefix, got[3].chosen, got[3].rejected) == (1, "", "")
