import hashlib
import itertools
import random
import re
from zlib import crc32

import pytest

from fixtures import rows
from parcelscope.llm.conversation_repair import Steps, damaged, repair, repaired_turns

COLS = ("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
SCHEMA = "conv_id long, turn long, role string, text string, cost string"


def damage(table):
    out = {}
    for conv, turn, role, text, *_ in table:
        own = out.setdefault(conv, [])
        kind = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        own += [(turn, role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for c, r in out.items()}


def faults(turns):
    out = []
    for i, (_, role, text) in enumerate(turns):
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not solid else "duplicate" if (role, text) in [t[1:] for t in turns[:i]]
                   else "truncated" if solid[-1] not in ".!?" else "")
    return out


def brute(table):
    """All prefixes of edit lists that are worth keeping, whole strings compared."""
    found = []
    for conv, turns in damage(table).items():
        kinds = faults(turns)
        best = {"": (0, "", ())}  # initials given so far, only what the pattern needs of them

        def ok(s):
            return re.fullmatch(r"(s?(ua)*u?)", s) is not None

        def put(into, initials, entry):
            full = initials
            key = full if len(full) <= 3 else full[:1] + "~" + full[-2:]
            if ok(full) and (key not in into or entry[:2] < into[key][1][:2]):
                into[key] = (full, entry)

        states = {"": ("", (0, "", ()))}

        def inserted(states):
            states = dict(states)
            for _ in range(4):
                for full, (cost, audit, text) in list(states.values()):
                    for r in ("user", "assistant"):
                        put(states, full + r[0], (cost + 3, audit + "I", (*text, f"{r}:")))
            return states

        for (_, role, text), kind in zip(turns, kinds):
            after = {}
            for full, (cost, audit, lines) in inserted(states).values():
                put(after, full, (cost + 4, audit + "D", lines))
                if kind not in ("blank", "duplicate"):
                    more = 3 if kind == "truncated" else 0
                    if role[:1] in ("s", "u", "a"):
                        put(after, full + role[:1], (cost + more, audit + "K", (*lines, f"{role}:{text}")))
                    for r in ("user", "assistant"):
                        put(after, full + r[0], (cost + 3 + more, audit + "R", (*lines, f"{r}:{text}")))
            states = after
        cost, audit, lines = min(e for full, e in inserted(states).values() if re.fullmatch(r"(s?(ua)+)?", full))
        have = [t[0] for t in turns if t[0] is not None]
        gaps = max(have) - min(have) + 1 - len(set(have)) if have else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        found.append((conv, gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit,
                      hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(found, key=repr)


def table(seed, conversations=120):
    rng = random.Random(seed)
    out = []
    for c in range(conversations):
        for t in range(rng.randrange(1, 12)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "uber"])
            text = rng.choice(["Yes.", "No", "why?  \n", " \t", "", None, "a.b", f"word {rng.randrange(4)}.", "é!\x0b"])
            out.append((c, rng.choice([t, t, t + 2, t // 2, None]), role, text, "x"))
    return out + [(None, 1, "user", "q.", "x"), (None, 2, "assistant", "a.", "x"), (None, None, None, None, None)]


@pytest.mark.parametrize("held", [1, 3, 100_000])
def test_same_as_brute_force(spark, held):
    data = table(1)
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    assert rows(repair(damaged(df), held=held), *COLS) == brute(data)


def test_batches_of_three_rows(spark):
    data = table(2)
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "3")
    try:
        assert rows(repair(damaged(spark.createDataFrame(data, SCHEMA)), held_bytes=20), *COLS) == brute(data)
    finally:
        spark.conf.set(conf, before)


def test_one_giant_conversation_goes_through_files(spark, tmp_path):
    rng = random.Random(3)
    data = [(7, t, rng.choice(["user", "assistant", "tool"]), rng.choice([f"text {t}.", f"text {t}", "same."]), "x") for t in range(3000)]
    data += [(8, 0, "user", "q.", "x"), (8, 1, "assistant", "a.", "x")]
    got = rows(repair(damaged(spark.createDataFrame(data, SCHEMA).repartition(6)), held=250), *COLS)
    assert got == brute(data)


def test_repaired_turns_are_what_was_hashed(spark):
    data = table(4, 30)
    broken = damaged(spark.createDataFrame(data, SCHEMA))
    edits = {}
    for r in sorted(repaired_turns(broken, held=2).collect(), key=lambda r: r["step"]):
        edits.setdefault(r["conv"], []).append(r)
    for s in repair(broken).collect():
        own = edits.get(s["conv"], [])
        assert "".join(r["edit"] for r in own) == s["audit"]
        left = [r for r in own if r["edit"] != "D"]
        assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in left).encode()).hexdigest() == s["repaired_sha256"]
        assert re.fullmatch(r"(s?(ua)+)?", "".join(r["role"][:1] for r in left))


def test_states_are_few():
    steps, todo = Steps(), [0]
    while todo:
        state = todo.pop()
        for initial, must_go, cut in itertools.product(("s", "u", "a", "t"), (False, True), (False, True)):
            known = len(steps.states)
            steps.step(state, initial, must_go, cut)
            todo += range(known, len(steps.states))
            assert len(steps.states) < 1000


def test_text_ids_long_texts_and_empty_table(spark):
    df = spark.createDataFrame([("k", 1, "user", "w " * 200_000 + "."), ("k", 2, "assistant", "ok.")], "conv string, turn int, role string, text string")
    assert rows(repair(df), "conv", "cost", "audit") == [("k", 0, "KK")]
    assert repair(damaged(spark.createDataFrame([], SCHEMA))).count() == 0
