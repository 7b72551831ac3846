"""Chat templates that are not plain concatenation, on conversations longer than a segment."""

from ledgerlens.llm import chat

TURNS = [("assistant" if t % 2 else "user", f"t{t}") for t in range(60)]


def shown(spark, template):
    rows = [(1, t, role, text) for t, (role, text) in enumerate(TURNS)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return chat.format_conversations(df, template).orderBy("segment").collect()


def test_a_beginning_is_said_once_and_spans_fit(spark):
    template = lambda m: "<begin>" + "".join(f"{i}:{r}:{t};" for i, (r, t) in enumerate(m))
    rows = shown(spark, template)
    assert "".join(r.formatted for r in rows) == template(TURNS)
    assert [r.formatted[a:b] for r in rows for a, b in r.spans] == [t for _, t in TURNS]
    assert [r.formatted[a:b] for r in rows for a, b in r.loss] == [t for _, t in TURNS[1::2]]
    assert not any(r.rewrites_history for r in rows)


def test_history_rewritten_late_is_found(spark):
    last_fifty = lambda m: "".join(f"{r}:{t};" for r, t in m[-50:])
    rows = shown(spark, last_fifty)
    assert any(r.rewrites_history for r in rows)
    assert "".join(r.formatted for r in rows) == last_fifty(TURNS)


def test_the_default_is_rendered_by_turn(spark):
    assert chat.bracket_template.by_turn
    assert chat.bracket_template(TURNS) == "".join(chat.bracket_template([t]) for t in TURNS)
    assert "".join(r.formatted for r in shown(spark, chat.bracket_template)) == chat.bracket_template(TURNS)


def test_a_wrong_mark_is_found_and_whole_prefixes_are_rendered(spark):
    numbered = chat.by_turn(lambda m: "".join(f"{i}:{r}:{t};" for i, (r, t) in enumerate(m)))
    rows = shown(spark, numbered)
    assert len(rows) == 1 and rows[0].formatted == numbered(TURNS) and not rows[0].rewrites_history
    assert [rows[0].formatted[a:b] for a, b in rows[0].spans] == [t for _, t in TURNS]
    last_fifty = chat.by_turn(lambda m: "".join(f"{r}:{t};" for r, t in m[-50:]))
    rows = shown(spark, last_fifty)
    assert [(r.formatted, r.rewrites_history, r.spans, r.loss) for r in rows] == [(last_fifty(TURNS), True, None, None)]
    got = chat.digest(chat.format_conversations(
        spark.createDataFrame([(1, t, r, x) for t, (r, x) in enumerate(TURNS)], "conv_id long, turn long, role string, text string"), last_fifty
    )).first()
    assert got.loss_chars is None and got.loss_sha256 is None


def test_long_conversations_of_a_marked_template_are_not_held(spark, monkeypatch):
    monkeypatch.setattr(chat, "CHECKED_CHARS", 100)
    rows = shown(spark, chat.bracket_template)
    assert [r.turns for r in rows] == [32, 28] and "".join(r.formatted for r in rows) == chat.bracket_template(TURNS)


def test_templates_that_refuse_hide_or_repeat(spark):
    def strict(m):
        if not m or m[0][0] != "user":
            raise ValueError("the first turn must be the user's")
        return "".join(f"{r}:{t};" for r, t in m)

    text, found, rewritten = chat.spans(strict, TURNS[:5])
    assert not rewritten and [text[a:b] for a, b in found] == [t for _, t in TURNS[:5]]
    twice = lambda m: "".join(f"{t}({t})" if r == "user" else t for r, t in m)
    assert chat.spans(twice, [("user", "aaaa"), ("assistant", "b")])[1] == [None, (10, 11)]
    hidden = lambda m: "".join("*" if r == "user" else t for r, t in m)
    assert chat.spans(hidden, [("user", "aaaa"), ("assistant", "b")])[1] == [None, (1, 2)]
    last_two = lambda m: "<".join(t for _, t in m[-2:])
    assert chat.spans(last_two, [("user", "aaaa"), ("user", "b"), ("user", "cc")])[1:] == (None, True)
    rows = shown(spark, lambda m: "".join(f"{t}{t};" if r == "assistant" else f"{t};" for r, t in m))
    assert rows[0].loss is None and rows[0].spans[0] is not None and rows[0].spans[1] is None
