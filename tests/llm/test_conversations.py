"""Conversation repair against plain Python: a table of least (cost, audit) per place and end."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

import __spark_entry__ as entry_points
from bazaarscope.llm import conversations as conv

WHITE = " \t\n\x0b\x0c\r"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
KEEP = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}
NAME = {"u": "user", "a": "assistant"}


def damaged(rows):
    out = []
    for c, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = ":".join(" " if x is None else str(x) for x in (c, turn))
        code = zlib.crc32(key.encode()) % 20
        if code == 0:
            continue
        text = "" if code == 1 else text.translate(dict.fromkeys(map(ord, ".!?"))) if code == 2 else text
        role = "user" if code == 4 else role
        out += [(c, turn, role, text)] * (2 if code == 3 else 1)
    return out


def order(row):
    _, turn, role, text = row
    digest = hashlib.md5(f"{len(role)}\x1f{role}\x1f{text}".encode()).hexdigest()
    return (turn is not None, turn or 0, role.encode(), digest)


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.strip(WHITE)
        fault = 0 if bare and bare[-1] in ".!?" else 1
        fault = 2 if not bare else 3 if (role, text) in seen else fault
        seen.add((role, text))
        out.append(fault)
    return out


def repaired(rows):
    """(cost, audit, [(role, text)]) of the cheapest, then least, repair."""
    fault = faults(rows)
    best = {(len(rows), ""): (0, ""), (len(rows), "a"): (0, "")}

    def inserts(i):
        for _ in range(3):
            for end, to in NEXT.items():
                if (i, to) in best:
                    c, s = best[i, to]
                    best[i, end] = min(best.get((i, end), (10**9, "")), (c + 5, "I" + s))

    inserts(len(rows))
    for i in range(len(rows) - 1, -1, -1):
        initial = rows[i][2][:1]
        for end in NEXT:
            ways = [(2 + best[i + 1, end][0], "D" + best[i + 1, end][1])]
            extra = 5 if fault[i] == 1 else 0
            if fault[i] < 2 and (end, initial) in KEEP:
                ways.append((extra + best[i + 1, initial][0], "K" + best[i + 1, initial][1]))
            if fault[i] < 2:
                ways.append((1 + extra + best[i + 1, NEXT[end]][0], "R" + best[i + 1, NEXT[end]][1]))
            best[i, end] = min(ways)
        inserts(i)
    cost, audit = best[0, ""]
    out, end, source = [], "", iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(source)[2:]
        if edit != "D":
            end = role[:1] if edit == "K" else NEXT[end]
            out.append((role if edit == "K" else NAME[end], text))
    return cost, audit, out


def expected(rows):
    groups = {r[0]: [] for r in rows}
    for r in damaged(rows):
        groups[r[0]].append(r)
    out = {}
    for c, own in groups.items():
        own.sort(key=order)
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        f = faults(own)
        initials = [r[2][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, texts = repaired(own)
        body = "\n".join(f"{r}:{t}" for r, t in texts)
        out[c] = (gaps, f.count(2), f.count(3), f.count(1), illegal, cost, audit,
                  hashlib.sha256(body.encode()).hexdigest())
    return out


def got(frame):
    rows = frame.collect()
    out = {r.conv_id: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    assert frame.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return out


SCHEMA = "conv_id long, turn long, role string, text string, label string, nr int, turns int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", 7, 1) for r in rows], SCHEMA).repartition(parts, "turn", "role", "text").cache()


def some_rows(rng, n_conversations, turns):
    rows = []
    for c in range(n_conversations):
        for t in range(rng.randint(1, turns)):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "uzr"])
            text = rng.choice(["Hi.", "Yes!", "no", "", " \t", None, "a?\n", "Hi.", f"Number {t}.", f"cut {t}"])
            rows.append((rng.choice([c, c, c, None]) if c == 3 else c, rng.choice([t, t, t, t + 2, None]), role, text))
    return rows


def test_query_matches_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    result = got(entry_points.queries()["op13_conversation_repair"](spark, sf_dir))
    assert result == expected(rows)
    assert {x for r in result.values() for x in r[6]} >= set("DKR")


def test_edges(spark):
    rows = some_rows(random.Random(1), 120, 9)
    rows += rows[:40]
    rows.append((999, -9223372036854775808 // 2, "user", "x" * 300_000 + "."))
    assert got(conv.report(frame(spark, rows))) == expected(rows)
    empty = spark.createDataFrame([], SCHEMA)
    assert conv.report(empty).collect() == [] and conv.repair(empty).collect() == []


def test_a_conversation_of_many_blocks(spark, monkeypatch):
    """One conversation holds most rows and is cut by tasks and by blocks."""
    monkeypatch.setattr(conv, "BLOCK_ROWS", 7)
    rng = random.Random(2)
    roles = ["user", "assistant", "system", "tool"]
    rows = [(5, t // 2 if t % 3 else t, rng.choice(roles), rng.choice(["Well.", "so", "", f"{t}."])) for t in range(700)]
    rows += some_rows(rng, 20, 6)
    assert got(conv.report(frame(spark, rows))) == expected(rows)


@pytest.mark.parametrize("seed", range(3))
def test_blocks_compose(seed):
    """The least path of every block joined is that of the whole."""
    rng = random.Random(seed)
    for _ in range(60):
        rows = [(0, i, rng.choice(["user", "assistant", "system", "x"]), rng.choice(["a.", "b.", f"{i}.", "c", ""])) for i in range(rng.randint(0, 30))]
        turns = [(r, t, f) for (_, _, r, t), f in zip(rows, faults(rows))]
        _, spell, cost = conv._ways([turns], [None])
        (audit,), _ = spell([0])
        want = repaired(rows)
        assert (int(cost[0, 0]), audit) == want[:2]
        assert [(r, t) for e, r, t in conv.edited(turns, audit, 0) if e != "D"] == want[2]


def test_repair_returns_the_texts(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "What?"), (1, 2, "assistant", "That."), (2, 0, "user", "Hm.")]
    out = sorted(tuple(r) for r in conv.repair(frame(spark, rows)).drop("block").collect())
    want = [(c, i, e, *x) for c, k in ((1, 3), (2, 1)) for i, (e, x) in enumerate(_edits([r for r in rows if r[0] == c]))]
    assert out == sorted(want)


def _edits(rows):
    _, audit, _ = repaired(rows)
    turns = [(r, t, f) for (_, _, r, t), f in zip(rows, faults(rows))]
    return [(e, (r, t)) for e, r, t in conv.edited(turns, audit, 0)]
