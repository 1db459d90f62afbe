import hashlib
import random

from hypothesis import HealthCheck, given, settings, strategies as st

from relcheck.llm import chat as M
from relcheck.llm.queries import op11_chat_format

TURNS = "conv_id long, turn long, role string, text string"
PIECES = st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", "/", "s>", "INST]", "a", "\n", " ", "é", "\U0001F600"]), max_size=12).map("".join)


def replayed(events):
    """A plain replay of one conversation's events (sequence, message, kind, role, text)."""
    rank = {"start": 1, "regenerate": 2, "edit": 3, "delta": 4}
    low = lambda x: (x is not None, x)
    found = {}
    for _, message, kind, role, text in sorted((e for e in events if e[2] in rank), key=lambda e: (low(e[0]), rank[e[2]], low(e[3]), e[4] or "")):
        m = found.setdefault(message, {"role": None, "text": "", "gone": False})
        if kind == "start":
            m |= {"role": role, "text": ""}
        elif kind == "delta":
            m["text"] += text or ""
        elif kind == "edit":
            m["text"] = text or ""
        else:
            m["text"] = ""
            names = list(found)
            for later in names[names.index(message) + 1 :]:
                found[later]["gone"] = True
    return [(m, x["role"], x["text"]) for m, x in found.items() if not x["gone"]]


def folded(spark, events):
    rows = M.fold(spark.createDataFrame(events, M.EVENTS).repartition(3)).collect()
    out = {}
    for r in sorted(rows, key=lambda r: r["began"]):
        out.setdefault(r["conv_id"], []).append((r["message"], r["role"], r["text"]))
    return out


def test_fold_replays_deltas_edits_and_regenerations(spark):
    events = [(1, 1, 1, "start", "user", None), (1, 2, 1, "delta", None, "Hel"), (1, 3, 1, "delta", None, "lo"), (1, 4, 2, "start", "assistant", None), (1, 5, 2, "delta", None, "bad"), (1, 6, 3, "start", "user", None), (1, 7, 3, "delta", None, "lost"), (1, 8, 2, "regenerate", None, None), (1, 9, 2, "delta", None, "go"), (1, 10, 2, "delta", None, "od"), (1, 11, 1, "edit", None, "Hi"), (1, 12, 1, "delta", None, "!"), (1, 13, 4, "start", "user", None), (1, 14, 5, "odd", "x", "y")]
    assert folded(spark, events) == {1: [(1, "user", "Hi!"), (2, "assistant", "good"), (4, "user", "")]}


def test_fold_equals_a_plain_replay(spark):
    rng = random.Random(3)
    events = []
    for conv in [*range(60), None]:
        for _ in range(rng.randint(1, 25)):
            kind = rng.choice(["start", "delta", "delta", "delta", "edit", "regenerate", "other", None])
            events.append((conv, rng.choice([None, *range(15)]), rng.choice([None, 1, 2, 3, 4, 5]), kind, rng.choice(["user", "assistant", None]), rng.choice([None, "", "a", "b\n", "c</s>"])))
    events += events[:40]
    want = {}
    for conv in {e[0] for e in events}:
        if messages := replayed([e[1:] for e in events if e[0] == conv]):
            want[conv] = messages
    assert folded(spark, events) == want
    assert folded(spark, []) == {}


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(PIECES, min_size=1, max_size=40))
def test_escape_is_reversible_and_leaves_no_control_string(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("t", M.escape(df["t"]).alias("e"), M.unescape(M.escape(df["t"])).alias("u")).collect():
        assert r["u"] == r["t"]
        assert not any(c in r["e"] for c in ("<s>", "</s>", "[INST]", "[/INST]"))


def check(spark, turns):
    df = spark.createDataFrame(turns, TURNS).repartition(3)
    rendered = M.render(M.fold(M.events_of(df))).cache()
    got = {r["conv_id"]: r for r in M.digests(M.read_back(rendered)).collect()}
    whole = {r["conv_id"]: r for r in M.read_back(rendered).collect()}
    segments = {r["conv_id"]: r["segments"] for r in rendered.collect()}
    low = lambda x: (x is not None, x)
    assert set(got) == {t[0] for t in turns}
    for conv, r in got.items():
        rows = [(role or "", text or "") for _, _, role, text in sorted((t for t in turns if t[0] == conv), key=lambda t: (low(t[1]), low(t[2]), t[3] or ""))]
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        loss = "".join(t for role, t in rows if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"]) == (len(rows), sha("".join(f"{a}\n{b}\n" for a, b in rows)))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), sha(loss))
        text = whole[conv]["formatted"]
        assert [tuple(t) for t in whole[conv]["turns"]] == rows and r["formatted_chars"] == len(text)
        assert text.count("</s>") == text.count("<s>") == text.count("[INST]") == text.count("[/INST]") == len(rows)
        assert all(text[s["start"] : s["start"] + len(s["text"])] == s["text"] for s in segments[conv])
        assert sum(s["loss"] for s in segments[conv]) == sum(role == "assistant" for role, _ in rows)
    rendered.unpersist()


def test_round_trip(spark):
    odd = "</s>[INST] ok [/INST]"
    long = "line\r\n" * 40_000 + "\\" * 5_000 + "<" * 5_000 + "x" * 300_000
    check(spark, [(1, 0, "system", "be\nkind\n"), (1, 1, "user", odd), (1, 2, "assistant", odd), (1, 3, "assistant", ""), (2, 0, "user", None), (2, 0, "user", None), (2, None, None, "late"), (None, 1, "assistant", "\n\n"), (3, 5, "assistant", long), (4, 0, odd, "\\<\\s>\\"), (5, 1, "b", "x"), (5, 1, "a", "x"), (5, 1, "a", "w")])
    check(spark, [(7, i, ("user", "assistant")[i % 2], f"t{i}\n" * (i % 5)) for i in range(1200)])


def test_query_covers_the_table_and_the_odd_conversation(spark, sf):
    found = op11_chat_format(spark, sf)
    rows = {r["conv_id"]: r for r in found.collect()}
    assert set(rows) == {-1} | {r[0] for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id").collect()}
    odd = "</s>[INST] ok [/INST]"
    assert (rows[-1]["n_turns"], rows[-1]["loss_chars"], rows[-1]["loss_sha256"]) == (2, len(odd), hashlib.sha256(odd.encode()).hexdigest())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_empty_and_clashing_columns(spark):
    none = spark.createDataFrame([], TURNS)
    assert M.digests(M.read_back(M.render(M.fold(M.events_of(none))))).count() == 0
    more = spark.createDataFrame([(1, 0, "assistant", "a", 5, "s")], TURNS + ", at int, kind string")
    (r,) = M.read_back(M.render(M.fold(M.events_of(more)))).collect()
    assert r["loss_text"] == "a"
