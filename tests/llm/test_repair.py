import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from rallyframe.llm import repair
from tests.llm.oracle import same

SHAPE = re.compile("(s?(ua)+)?")


def faults(rows):
    seen, found = set(), []
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\f\r")
        found.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return found


def cheapest(rows):
    """By trying every audit with every role, on short conversations."""
    found, best = faults(rows), None
    for extra in range(len(rows) + 2):
        for edits in itertools.product(*[["K", "Ru", "Ra", "D"] if f not in ("blank", "duplicate") else ["D"] for f in found]):
            for places in itertools.combinations_with_replacement(range(len(rows) + 1), extra):
                for roles in itertools.product("ua", repeat=extra):
                    cost, audit, out = 3 * extra, "", []
                    for i in range(len(rows) + 1):
                        for p, r in zip(places, roles):
                            if p == i:
                                audit, out = audit + "I", [*out, ({"u": "user", "a": "assistant"}[r], "")]
                        if i < len(rows):
                            e = edits[i]
                            audit += e[0]
                            cost += {"K": 0, "R": 3, "D": 4}[e[0]] + (3 if e != "D" and found[i] == "truncated" else 0)
                            if e != "D":
                                out.append((rows[i][0] if e == "K" else {"u": "user", "a": "assistant"}[e[1]], rows[i][1]))
                    if all(r for r, _ in out) and SHAPE.fullmatch("".join(r[0] for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
                        best = (cost, audit, out)
    return best


def test_cheapest_edits(spark):
    rng = random.Random(7)
    texts = ["Yes.", "no", "", " \t", "What? ", "Well!\n", "cut", "é."]
    convs = {c: [(rng.choice(["user", "assistant", "system", "user", "assistant", "tool", ""]), rng.choice(texts)) for _ in range(rng.randrange(1, 5))] for c in range(60)}
    rows = [(c, t, r, x, "extra") for c, turns in convs.items() for t, (r, x) in enumerate(turns)]
    got = repair.repaired(repair.numbered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, cost string"))).collect()
    assert len(got) == len(convs)
    for g in got:
        turns = convs[g.conv_id]
        cost, audit, out = cheapest(turns)
        assert (g.cost, g.audit, [tuple(t) for t in g.turns]) == (cost, audit, out), (turns, g, cost, audit)
        n = Counter(faults(turns))
        illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in zip(turns, turns[1:]))
        assert (g.blank, g.duplicate, g.truncated, g.illegal, g.gaps) == (n["blank"], n["duplicate"], n["truncated"], illegal, 0)


def by_steps(rows):
    """The fold in plain Python, for long conversations."""
    never = (1 << 60, "", ())
    ins = lambda s, r: (s[0] + 3, s[1] + "I", (s[2], (r, "")))
    close = lambda s: (lambda u: [s[0], s[1], u, min(s[3], ins(u, "assistant"), key=lambda x: x[:2])])(min([s[2], *(ins(s[k], "user") for k in (0, 1, 3))], key=lambda x: x[:2]))
    s = close([(0, "", ()), never, never, never])
    for (role, text), fault in zip(rows, faults(rows)):
        more, nxt = 3 * (fault == "truncated"), [[(x[0] + 4, x[1] + "D", x[2])] for x in s]
        if fault not in ("blank", "duplicate"):
            for to, froms, initial, name in ((1, (0,), "s", None), (2, (0, 1, 3), "u", "user"), (3, (2,), "a", "assistant")):
                for k in froms:
                    if role[:1] == initial:
                        nxt[to].append((s[k][0] + more, s[k][1] + "K", (s[k][2], (role, text))))
                    if name:
                        nxt[to].append((s[k][0] + more + 3, s[k][1] + "R", (s[k][2], (name, text))))
        s = close([min(x, key=lambda y: y[:2]) for x in nxt])
    cost, audit, chain = min(s[0], s[3], key=lambda x: x[:2])
    out = []
    while chain:
        chain, turn = chain
        out.append(turn)
    return cost, audit, out[::-1]


def test_long_conversations(spark):
    rng = random.Random(3)
    convs = {c: [(rng.choice(["user", "assistant", "system"]), f"{rng.randrange(n)}{rng.choice(['.', '', '!'])}") for _ in range(n)] for c, n in enumerate([511, 512, 513, 1030, 2500])}
    rows = [(c, t, r, x) for c, turns in convs.items() for t, (r, x) in enumerate(turns)]
    for g in repair.repaired(repair.numbered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect():
        assert (g.cost, g.audit, [tuple(t) for t in g.turns]) == by_steps(convs[g.conv_id])


def test_nulls_ties_and_gaps(spark):
    rows = [
        (1, None, "user", "Hello."), (1, 3, "assistant", "b."), (1, 3, "assistant", "a."), (1, 9, "user", None), (1, 9, None, "x."),
        (None, None, None, None), (None, 2**63 - 1, "user", "u."), (None, -(2**63), "assistant", "v."), (2, None, "system", "s."), (3, 1, "user", "u." * 200_000), (3, 1, "user", "u." * 200_000),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in repair.repaired(repair.numbered(df)).collect()}
    assert set(got) == {1, 2, 3, None}
    # in order: user, assistant a., assistant b., null role x., blank user
    assert (got[1].gaps, got[1].blank, got[1].cost, got[1].audit) == (5, 1, 10, "KKRRD") and got[1].turns[2].role == "user"
    assert (got[None].gaps, got[None].blank, got[None].cost, got[None].audit) == (None, 1, 10, "DIKKI")
    assert (got[2].cost, got[2].audit, got[2].turns, got[2].gaps) == (4, "D", [], 0)
    assert (got[3].duplicate, got[3].gaps, got[3].audit) == (1, 0, "KDI")
    assert repair.repaired(repair.numbered(df.limit(0))).count() == 0


def test_damage(spark):
    rows = [(c, t, "assistant", "A! b? c.") for c in (-3, 0, 5, None) for t in [*range(40), None]]
    got = Counter((r.conv_id, r.turn, r.role, r.text) for r in repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).where(~F.col("gone")).collect())
    want = Counter()
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        new = (c, t, "user" if kind == 4 else role, "" if kind == 1 else "A b c" if kind == 2 else text)
        want[new] += (kind != 0) + (kind == 3)
    assert got == +want


def test_conversations_without_turns(spark, tmp_path):
    gone = [c for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    spark.createDataFrame([(c, 0, "user", "Hi.", 1) for c in gone], "conv_id long, turn long, role string, text string, place int").write.parquet(f"{tmp_path}/conversations.parquet")
    rows = repair.query(spark, str(tmp_path)).collect()
    assert len(rows) == len(gone) > 0
    assert {tuple(r)[1:] for r in rows} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_sql(spark):
    for sf in ("sf0.001", "sf0.01", "sf0.1"):
        path = f"/root/testdata/{sf}"
        assert same(repair.query(spark, path), repair.SQL, path) > 1
