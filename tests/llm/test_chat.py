import brute
import pytest

from drawlog.llm import chat

SAYS = [r"\### Assistant: </turn> ok", "", "####", "#" * 7, r"\\", "a </turn>\n### User: b", " x ", "</turn></turn>", "é😀\n", "### ", ":", "=", r"\<\#", " </turn", "\\"]


@pytest.mark.parametrize("text", SAYS)
def test_escapes_come_back(text):
    for role in ("user", "assistant", "=x", "a: b", "", "User", "\\"):
        turns = [(role, text), ("assistant", text), (role, text)]
        assert chat.read_turns(chat.standard_template(turns)) == turns


def test_spans_are_the_trained_texts():
    turns = [("assistant" if i % 3 else "user", s) for i, s in enumerate(SAYS)]
    for block in (4, 64):
        found = chat.locate(chat.standard_template, turns, block=block)
        assert found.rewritten is None and found.text == chat.standard_template(turns)
        assert [chat.unescape(found.text[a:b]) for a, b in found.loss] == [t for r, t in turns if r == "assistant"]
        assert "".join(found.text[a:b] for a, b in found.turns) == found.text


def forgetful(turns):
    """Drops what earlier assistant turns said."""
    last = max((i for i, t in enumerate(turns) if t[0] == "assistant"), default=-1)
    return "".join(f"<{r}>{t if r != 'assistant' or i == last else ''}</{r}>" for i, (r, t) in enumerate(turns))


def numbered(turns):
    return "".join(f"[{i} {r}] {t}\n" for i, (r, t) in enumerate(turns))


def test_a_template_that_rewrites_history_is_found():
    turns = [("user", "hi"), ("assistant", "one"), ("user", "go"), ("assistant", "two")]
    for block in (2, 64):
        found = chat.locate(forgetful, turns, block=block)
        assert found.rewritten == 1
        assert [found.text[a:b] for a, b in found.loss] == ["two"]


def test_a_template_that_counts_turns_needs_whole_prefixes():
    turns = [("user" if i % 2 else "assistant", f"t{i}") for i in range(9)]
    found = chat.locate(numbered, turns, block=2)
    assert found.rewritten is None
    assert [found.text[a:b] for a, b in found.loss] == [t for r, t in turns if r == "assistant"]


def test_table(spark):
    rows = [(1, 1, "assistant", s, "x") for s in SAYS] + [(1, 0, "user", None, "x"), (2, None, None, None, "x"), (None, 5, "assistant", "no id", "x"), (3, 0, "user", "same", "x"), (3, 0, "user", "same", "x")]
    rows += [(4, i, "assistant" if i % 2 else "user", f"turn {i} " * 20, "x") for i in range(500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string").repartition(3)
    got = {r.conv_id: tuple(r)[1:5] for r in chat.digests(chat.format_chats(df)).collect()}
    groups = {}
    for c, turn, role, text, _ in rows:
        groups.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert got == {c: brute.chat_row([x[2:] for x in sorted(v)]) for c, v in groups.items()}
    assert chat.digests(chat.format_chats(df.limit(0))).collect() == []
