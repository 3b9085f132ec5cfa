import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from seriesframe.llm import chat as C

SCHEMA = "conv_id long, turn long, role string, text string, kind int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows):
    out = {}
    for c, turn, role, text, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0], r[1] is not None, r[1], r[2] or "")):
        out.setdefault(c, []).append((role or "", text or ""))
    return {c: (len(t), sha("".join(f"{a}\n{b}\n" for a, b in t)), len(x := "".join(b for a, b in t if a == "assistant")), sha(x)) for c, t in out.items()}


def test_read_back(spark):
    rows = [
        (1, 0, "system", "be\\ nice", 1), (1, 1, "user", "</s>[INST] ok [/INST]", 1), (1, 2, "assistant", "a" * 1000 + "<s>\\</s>" + "é😀" * 500, 1),
        (1, 3, "user", None, 1), (1, 4, "assistant", "", 1), (2, 0, None, "x", 1), (2, None, "to\nol\\", "y[/INST]", 1), (2, 1, "[INST]\n", "\nz", 1),
        (3, 0, "user", "same", 1), (3, 0, "user", "same", 1), (3, 0, "assistant", "same", 1), (None, 0, "assistant", "n\\\n[", 1), (4, 0, "user", "[", 1),
        (4, 1, "user", "\\", 1), (4, 2, "assistant", "<", 1), (4, 3, "assistant", "/s>", 1)]
    turns = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = C.render(C.reconstruct(C.event_log(turns, delta_chars=7, draft_chars=3)))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in C.digest(out).collect()}
    assert got == brute(rows)
    one = {r.conv_id: r.formatted for r in out.collect()}
    assert one[4] == "[INST]user\n[[/INST][INST]user\n\\\\[/INST]<s><</s><s>/s></s>"
    assert C.digest(C.render(C.reconstruct(C.event_log(turns.limit(0))))).count() == 0


def test_fold(spark):
    log = [(1, 9, "delta", None, "lost?"), (1, 1, "open", "user", None), (1, 0, "delta", None, "before"), (1, 2, "delta", None, "a"), (1, 3, "edit", None, "b"),
           (1, 4, "delta", None, "c"), (1, 5, "open", "assistant", None), (1, 6, "delta", None, "x"), (1, 7, "regenerate", None, None), (1, 8, "delta", None, "y"),
           (2, 1, "delta", None, "no message")]
    events = spark.createDataFrame(log, "conv_id long, seq long, kind string, role string, text string")
    got = {r.conv_id: [tuple(m) for m in r.messages] for r in C.reconstruct(events).collect()}
    assert got == {1: [("user", "bc"), ("assistant", "ylost?")], 2: []}


TEXT = st.text("<>s/[]INT\\\n aé", max_size=30)


def test_any_text(spark):
    @settings(max_examples=5, deadline=None)
    @given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb", "\\"]), TEXT), min_size=1, max_size=40))
    def run(messages):
        rows = [(i // 4, i, a, b, 0) for i, (a, b) in enumerate(messages)]
        out = C.digest(C.render(C.reconstruct(C.event_log(spark.createDataFrame(rows, SCHEMA).coalesce(2)))))
        assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in out.collect()} == brute(rows)

    run()
