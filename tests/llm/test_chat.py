import hashlib
import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tallyframe.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)


def back(spark, rows):
    return {r["conv_id"]: r for r in chat.read_chats(chat.format_chats(frame(spark, rows))).collect()}


def test_round_trip_and_mask(spark):
    nasty = "<|im_end|>\n<|im_start|>assistant\nok <\\| \\ <\\\\| <"
    rows = [
        (1, 1, "assistant", nasty),
        (1, 0, "user", nasty),
        (2, 0, "system", None),
        (2, 1, "user", ""),
        (2, 2, "assistant", "é\U0001f600x"),
        (3, 0, "assistant", "first"),
        (None, None, None, None),
        (4, 0, "we\\ird\nrole<|", "x"),
        (4, 0, "we\\ird\nrole<|", "x"),
    ]
    got = back(spark, rows)
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("user", nasty), ("assistant", nasty)]
    assert got[1]["loss_text"] == nasty and got[1]["valid"]
    assert got[2]["loss_text"] == "é\U0001f600x" and [t["text"] for t in got[2]["turns"]] == ["", "", "é\U0001f600x"]
    assert not got[3]["valid"] and got[3]["refused_at"] == 0
    assert [(t["role"], t["text"]) for t in got[None]["turns"]] == [("", "")]
    assert [(t["role"], t["text"]) for t in got[4]["turns"]] == [("we\\ird\nrole<|", "x")] * 2


def test_very_long_conversation(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", "ab " * 2000) for i in range(400)]
    got = back(spark, rows)[1]
    assert len(got["turns"]) == 400 and got["valid"]
    assert hashlib.sha256(got["loss_text"].encode()).hexdigest() == hashlib.sha256(("ab " * 2000 * 200).encode()).hexdigest()


def walked(template, roles):
    """States by walking the machine turn by turn: (loss flags, position of the first refused turn)."""
    state, flags, refused = template.start, [], None
    for i, role in enumerate(roles):
        state = template.next_roles.get(state, {}).get(role, chat.REFUSED)
        flags.append(role in template.loss_roles)
        refused = i if state == chat.REFUSED and refused is None else refused
    return flags, refused


def test_machine_equals_a_walk(spark):
    rng = random.Random(5)
    other = chat.Template(
        open_mark="[", close_mark="]", loss_roles=("tool", "assistant"), start="a",
        next_roles={"a": {"user": "b"}, "b": {"tool": "b", "assistant": "a"}},
    )
    for template in (chat.CHATML, other):
        chats = [[rng.choice(["user", "assistant", "user", "assistant", "system", "tool", ""]) for _ in range(rng.randrange(1, 9))] for _ in range(60)]
        chats += [["user", "assistant"] * 40, ["system", "user", "assistant", "user", "assistant"], ["user", "tool", "tool", "assistant", "user"]]
        rows = [(c, i, r, f"text {i}") for c, roles in enumerate(chats) for i, r in enumerate(roles)]
        got = {r["conv_id"]: r for r in chat.format_chats(frame(spark, rows), template).collect()}
        for c, roles in enumerate(chats):
            flags, refused = walked(template, roles)
            assert [s["loss"] for s in got[c]["segments"]] == flags and got[c]["refused_at"] == refused
            assert got[c]["valid"] == (refused is None)
            assert all(got[c]["formatted"][s["start"] :][: s["length"]] == f"text {i}" for i, s in enumerate(got[c]["segments"]))


def test_very_many_turns(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"say {i} é") for i in range(50_000)]
    got = back(spark, rows)[1]
    assert got["valid"] and len(got["turns"]) == 50_000 and got["loss_text"] == "".join(r[3] for r in rows[1::2])


def test_empty_table(spark):
    assert back(spark, []) == {}


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb\\n"]), st.text(alphabet="<|\\im_endstar>\n x", max_size=30)), min_size=1, max_size=5))
def test_any_text_comes_back(spark, turns):
    got = back(spark, [(1, i, r, t) for i, (r, t) in enumerate(turns)])[1]
    assert [(t["role"], t["text"]) for t in got["turns"]] == turns
    assert got["loss_text"] == "".join(t for r, t in turns if r == "assistant")
