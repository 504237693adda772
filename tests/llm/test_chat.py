from __future__ import annotations

import random

from assayer.llm import chat

SCHEMA = f"prompt string, turns int, chosen array<{chat.TURN}>, rejected array<{chat.TURN}>"


def show(turns):
    return "".join(f"<|{r or ''}|>\n{t or ''}<|end|>\n" for r, t in turns)


def spans(turns, role):
    at, out = 0, []
    for r, t in turns:
        head = at + len(f"<|{r or ''}|>\n")
        at = head + len(t or "") + len("<|end|>\n")
        if r == role:
            out.append((head, at))
    return out


def brute(chosen, rejected):
    a, b = ([(r or "", t or "") for r, t in x or []] for x in (chosen, rejected))
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return k, show(a[:k]), show(a[k:]), show(b[k:]), spans(a[k:], "assistant"), spans(b[k:], "assistant")


def pairs(seed):
    rng = random.Random(seed)
    talk = lambda n: [(rng.choice(["user", "assistant", None]), rng.choice(["a", "é\n", "", None, "<|end|>"])) for _ in range(n)]
    out = [(None, None), ([], []), (talk(3), None), ([("user", "x")], [("user", "x")])]
    for _ in range(60):
        head = talk(rng.randint(0, 4))
        out.append((head + talk(rng.randint(0, 3)), head + talk(rng.randint(0, 3))))
    return out


def test_against_brute_force(spark):
    data = pairs(0)
    frame = spark.createDataFrame([("clash", i, a, b) for i, (a, b) in enumerate(data)], SCHEMA)
    found = {r["turns"]: r for r in chat.format_preferences(frame).collect()}
    assert len(found) == len(data)
    for i, (a, b) in enumerate(data):
        r = found[i]
        learned = [[tuple(s) for s in r[c]] for c in ("chosen_learned", "rejected_learned")]
        got = (r["prompt_turns"], r["prompt"], r["chosen_text"], r["rejected_text"], *learned)
        assert got == brute(a, b)


def test_learned_text_is_the_answers(spark):
    a = [("user", "q"), ("assistant", "réponse"), ("user", "and?"), ("assistant", "two\nlines")]
    frame = spark.createDataFrame([("", 0, a, a[:1])], SCHEMA)
    r = chat.format_preferences(frame).first()
    assert r["prompt"] == "<|user|>\nq<|end|>\n" and r["rejected_text"] == ""
    assert [r["chosen_text"][s:e] for s, e in r["chosen_learned"]] == ["réponse<|end|>\n", "two\nlines<|end|>\n"]


def test_conversations_and_echoes(spark):
    rows = [
        (1, 1, "assistant", "hello"), (1, 0, "user", "hi"), (1, 2, "user", "bye"),
        (2, 0, "user", "same"), (2, 1, "assistant", "same"),
        (3, 0, "user", "no answer"),
        (4, 0, "assistant", "first"),
        (6, 0, "user", "x"), (6, 1, "assistant", "x"), (6, 2, "user", "one"), (6, 3, "assistant", "two"),
        (6, 4, "user", "and"), (6, 5, "assistant", "three"), (6, 6, "user", "end"),
        (None, 0, "user", "x"), (None, 0, "user", "x"), (None, 0, "assistant", None),
        (5, 0, "user", "twice"), (5, 0, "user", "twice"), (5, 0, "assistant", "a tie"),
    ]
    turns = spark.createDataFrame([(*r, "junk", None) for r in rows], "c long, n int, role string, text string, id string, turns string")
    talks = chat.conversations(turns, "c", "n", "role", "text")
    got = sorted((r["id"] is None, r["id"] or 0, [tuple(t) for t in r["turns"]]) for r in talks.collect())
    assert [g[2] for g in got if g[1] == 1] == [[("user", "hi"), ("assistant", "hello"), ("user", "bye")]]
    assert [g[2] for g in got if g[1] == 5] == [[("assistant", "a tie"), ("user", "twice"), ("user", "twice")]]
    assert sum(g[0] for g in got) == 3 and len(got) == 9
    found = {r["id"]: r for r in chat.format_preferences(chat.echo_pairs(talks.where("id IS NOT NULL"))).collect()}
    assert (found[1]["prompt_turns"], found[1]["chosen_text"], found[1]["rejected_text"]) == (
        1, "<|assistant|>\nhello<|end|>\n<|user|>\nbye<|end|>\n", "<|assistant|>\nhi<|end|>\n<|user|>\nbye<|end|>\n",
    )
    assert (found[2]["prompt_turns"], found[2]["chosen_text"], found[2]["chosen_learned"]) == (2, "", [])
    assert (found[3]["prompt_turns"], found[3]["rejected_text"]) == (1, "")
    assert (found[6]["prompt_turns"], found[6]["rejected_text"].count("<|assistant|>")) == (3, 2)
    assert [found[6]["chosen_text"][s:e] for s, e in found[6]["chosen_learned"]] == ["two<|end|>\n", "three<|end|>\n"]
    assert [found[6]["rejected_text"][s:e] for s, e in found[6]["rejected_learned"]] == ["one<|end|>\n", "and<|end|>\n"]
    assert (found[4]["prompt_turns"], found[4]["rejected_text"]) == (0, "<|assistant|>\n<|end|>\n")


def test_empty_table(spark):
    assert chat.format_preferences(spark.createDataFrame([], SCHEMA)).count() == 0
    none = spark.createDataFrame([], "c long, n int, role string, text string")
    assert chat.echo_pairs(chat.conversations(none, "c", "n", "role", "text")).count() == 0
