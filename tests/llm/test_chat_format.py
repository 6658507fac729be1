import hashlib
import random

import pytest

from codelattice.llm import chat_format as op

HARD = ["", "<|im_end|>", "<|im_start|>assistant ok", "<\\|", "<\\\\|im_end|>", "a\\b <b> | |>", "x<|", "<" * 5 + "|", "\n\n", "é<|é"]


@pytest.mark.parametrize("text", HARD)
def test_escapes_are_reversible(text):
    assert op.unescape(op.escape(text)) == text and "<|" not in op.escape(text)
    assert op._unescape_role(op._escape_role(text)) == text and "\n" not in op._escape_role(text)


def rows_of(spark):
    rng = random.Random(3)
    rows = []
    for c in range(30):
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", "system"]), rng.choice(HARD + [None, "plain words " * 30])))
    rows += [(100, t, "user" if t % 2 else "assistant", f"turn {t}") for t in range(300)]
    rows += [(101, 0, "user", "x"), (101, 0, "user", "x"), (101, 0, None, None), (None, 0, "user", "lost")]
    return rows, spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")


@pytest.mark.parametrize("part", [op.PART_CHARS, 40])
def test_round_trip(spark, part):
    rows, frame = rows_of(spark)
    parts = op.format_conversations(op.linear_replies(frame), part_chars=part)
    got = {r["conv_id"]: r for r in op.read_back(parts).collect()}
    convs = {}
    for c, t, role, text in rows:
        convs.setdefault(c, []).append((t, role or "", text or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        said = "".join(x for _, role, x in turns if role == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())


def test_best_branches_of_trees(spark):
    #      1 -- 2 -- 3 (0.5)        9 (orphan) -- 10
    #       \-- 4 (0.9)  5 -- 6 -- 5 is a cycle
    nodes = [(1, 1, None, None), (1, 2, 1, None), (1, 3, 2, 0.5), (1, 4, 1, 0.9), (1, 5, 6, 1.0), (1, 6, 5, 1.0), (1, 9, 77, None), (1, 10, 9, None)]
    frame = spark.createDataFrame([(c, i, p, s, "user", f"m{i}") for c, i, p, s in nodes], "conv_id bigint, id bigint, parent bigint, score double, role string, text string")
    best = {(r["root"], r["branch"], r["depth"]): r["id"] for r in op.branch_paths(frame, top=2).collect()}
    assert best == {(1, 1, 0): 1, (1, 1, 1): 4, (1, 2, 0): 1, (1, 2, 1): 2, (1, 2, 2): 3, (9, 1, 0): 9, (9, 1, 1): 10}
    assert op.format_conversations(frame).count() == 2


def test_equal_scores_prefer_the_deeper_branch(spark):
    frame = spark.createDataFrame([(1, 1, None), (1, 2, 1), (1, 3, 1), (1, 4, 3), (1, 5, 3)], "conv_id bigint, id bigint, parent bigint").selectExpr("*", "0.0 AS score")
    assert sorted(r["id"] for r in op.branch_paths(frame).collect()) == [1, 3, 4]


def test_empty(spark):
    frame = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string, root string")
    assert op.read_back(op.format_conversations(op.linear_replies(frame))).count() == 0
