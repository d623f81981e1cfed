from __future__ import annotations

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from quillstream.llm import chat_format

SCHEMA = "conv_id bigint, turn bigint, role string, text string, spans string"
PIECES = st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[TURN", "[TURN x", "<", "[", "\\", "\\\\", "/s>", "s>", " ", "a", "\n", "", "ñ😀", "\ue000", "\ue001"])
TEXT = st.lists(PIECES, max_size=8).map("".join)


@settings(deadline=None, max_examples=300)
@given(TEXT)
def test_escape_is_reversible_and_hides_control_strings(text):
    escaped = chat_format.escape(text)
    assert chat_format.unescape(escaped) == text
    assert not any(c in escaped for c in ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]"))


ROLE = st.sampled_from(["user", "assistant", "system", "tool", "", "odd] role\n", "\ue000", "a\ue000b"])


@settings(deadline=None, max_examples=200)
@given(st.lists(st.tuples(ROLE, TEXT), min_size=1, max_size=6))
def test_spans_read_back(turns):
    r = chat_format.render_incrementally(turns, chat_format.inst_template)
    assert r.rewritten_at is None and r.spans[0][0] == 0 and r.spans[-1][1] == len(r.text)
    for (a, b, c, d), (role, text) in zip(r.spans, turns, strict=True):
        assert a <= c <= d <= b
        assert chat_format.unescape(r.text[c:d]) == text and chat_format.inst_role(r.text[a:c]) == role


def test_rewriting_templates_are_detected():
    def forgetful(turns):
        """Shows the texts of the last two turns only."""
        return "".join(f"<{role}>{text if i >= len(turns) - 2 else '...'}\n" for i, (role, text) in enumerate(turns))

    turns = [("user", "first text"), ("assistant", "second"), ("user", "third"), ("assistant", "fourth")]
    r = chat_format.render_incrementally(turns, forgetful)
    assert r.rewritten_at == 2 and r.text == forgetful(turns)
    assert r.text[r.spans[-1][2] : r.spans[-1][3]] == "fourth"
    assert all(b <= len(r.text) for s in r.spans for b in s)
    dropping = lambda turns: "".join(f"[{role}]" for role, _ in turns)
    assert chat_format.render_incrementally(turns, dropping).rewritten_at is None


def test_odd_rows(spark, frame):
    rows = [(1, 1, "assistant", None, "x"), (1, 0, "user", "hi", "x"), (2, None, None, None, "x"), (None, 0, "user", "n", "x"), (3, 0, "user", "b", "x"), (3, 0, "user", "a", "x"), (3, 0, "user", "a", "x"),
            (4, 0, "assistant", "long " * 60_000, "x")]
    formatted = chat_format.format_conversations(spark, frame(rows, SCHEMA))
    got = {r["conv_id"]: r for r in chat_format.read_back(spark, formatted).collect()}
    digest = lambda turns: hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert got[1]["turns_sha256"] == digest([("user", "hi"), ("assistant", "")]) and got[1]["loss_chars"] == 0
    assert got[2]["turns_sha256"] == digest([("", "")])
    assert got[3]["n_turns"] == 3 and got[3]["turns_sha256"] == digest([("user", "a"), ("user", "a"), ("user", "b")])
    assert got[4]["loss_chars"] == 300_000 and None in got
    assert chat_format.format_conversations(spark, frame([], SCHEMA)).count() == 0
