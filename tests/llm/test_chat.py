"""Chat formatting: templates that keep and that rewrite history, exact round trips, the loss mask."""
import hashlib
import random

import pytest
from hypothesis import given, settings, strategies as st

from codegrid.llm import chat

PARTS = chat.BRACKETS + chat.TAGS + ["\\", "<", "[", "/", "s>", "INST]", " ", "\n", "x", "é", "\U0001f600", "|", "end", "<|im"]
texts = st.lists(st.sampled_from(PARTS), max_size=8).map("".join)
roles = st.sampled_from(["system", "user", "assistant", "tool", "", "a\nb", "[/ROLE]", "<|im_end|>"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(roles, texts), max_size=6), st.sampled_from(sorted(chat.TEMPLATES)))
def test_round_trip(turns, name):
    formatted, spans, rewrites = chat.locate(chat.TEMPLATES[name], turns)
    assert rewrites is None and chat.read(formatted, name) == turns and formatted == chat.TEMPLATES[name](turns)
    assert [chat.Escape.take(formatted[c:d]) for _, _, c, d in spans] == [t for _, t in turns]
    assert [a for a, *_ in spans[1:]] == [b for _, b, *_ in spans[:-1]]
    for _, _, c, d in spans:
        assert not any(s in formatted[c:d] for s in (chat.BRACKETS if name == "brackets" else chat.TAGS))


def closing(turns):
    return "".join(f"{r}: {t}\n" for r, t in turns) + "(end)"


def forgetful(turns):
    """Thoughts of earlier answers go when a turn follows."""
    return "".join(f"<{r}>{t if i + 1 == len(turns) else t.split('#')[0]}</{r}>" for i, (r, t) in enumerate(turns))


def test_a_moving_tail_is_no_rewriting():
    turns = [("user", "hi"), ("assistant", "(e"), ("user", "more")]
    formatted, spans, rewrites = chat.locate(closing, turns)
    assert rewrites is None and [formatted[c:d] for *_, c, d in spans] == ["hi", "(e", "more"]


def test_rewritten_history_is_found():
    assert chat.locate(forgetful, [("user", "a"), ("assistant", "b")])[2] is None
    formatted, spans, rewrites = chat.locate(forgetful, [("user", "a"), ("assistant", "b#why"), ("user", "c"), ("assistant", "d")])
    assert rewrites == 2 and spans == [] and "why" not in formatted


def test_frames_that_depend_on_the_text_are_found():
    assert chat.locate(lambda turns: "".join(f"{len(t)}:{t};" for _, t in turns), [("user", "long text")])[2] == 0


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(3)
    rows = [(i, t, rng.choice(["system", "user", "assistant", "tool", None]), rng.choice(["", None, "plain", "</s>[INST] ok [/INST]", "back\\slash", "é" * 40]))
            for i in range(40) for t in range(rng.randrange(1, 9))]
    rows += [(50, t % 200, "assistant" if t % 2 else "user", f"turn {t}") for t in range(400)]  # long, with equal turns
    rows += [(None, 0, "user", "no id"), (None, 1, "assistant", "none"), (51, None, "user", "late"), (51, 0, "assistant", "early"), (52, 0, "user", "x"), (52, 0, "user", "x"),
             (53, 0, "assistant", "long " * 100_000)]
    return rows, spark.createDataFrame([(*r, 7, "s") for r in rows], "conv_id long, turn long, role string, text string, n_turns int, spans string")


def test_digests(table):
    rows, df = table
    want = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(conv, []).append((role or "", text or ""))
    got = chat.digests(chat.format_conversations(df)).collect()
    assert len(got) == len(want)
    for r in got:
        turns = want[r.conv_id]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in turns).encode()).hexdigest()
        assert r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.formatted_chars == len(chat.brackets(turns))


def test_operator_with_a_template_of_ones_own(table):
    _, df = table
    def own(turns):  # sent by value: workers do not import this module
        return "".join(f"<{r}>{t}</{r}>" for r, t in turns)
    rows = {r.conv_id: r for r in chat.format_conversations(df.where("conv_id IN (51, 52)"), own, trained=("user",)).collect()}
    assert rows[51].formatted == "<assistant>early</assistant><user>late</user>" and rows[51].rewrites is None
    assert [s.trained for s in rows[51].spans] == [False, True] and rows[52].n_turns == 2


def test_empty_table(spark):
    out = chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert out.count() == 0 and chat.digests(out).count() == 0
