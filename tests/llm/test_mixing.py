from collections import Counter

import pytest

from rallyframe.llm import mixing
from tests.llm.oracle import same


def slots_of(spark, sizes, weights=None):
    plan = mixing.schedule(spark.createDataFrame(sizes, "source string, n long"), weights).collect()
    return {r.source: r for r in plan}


@pytest.mark.parametrize("weights", [None, {"a": 3, "b": 1}, {"c": 0.2, "a": 0.7, "b": 0.1}, {}])
def test_every_prefix_is_less_than_a_block_off(spark, weights):
    plan = slots_of(spark, [("a", 900), ("b", 64), ("c", 4000), ("", 1)], weights)
    owner = {t: s for s, r in plan.items() for t in r.slots}
    assert sorted(owner) == list(range(mixing.PERIOD)) and sum(r.parts for r in plan.values()) == mixing.PERIOD
    seen = Counter()
    for t in range(mixing.PERIOD):
        for s, r in plan.items():
            assert abs(seen[s] - t * r.parts / mixing.PERIOD) < 1
        seen[owner[t]] += 1
    assert all(r.placed >= r.blocks for r in plan.values())


def test_cases(spark):
    docs = [(i, f"t{i}", "abc"[i % 3] if i % 50 else None, 0) for i in range(500)] + [(7, "again", "b", 0), (None, None, "c", 0), (8, "", "", 0)]
    df = spark.createDataFrame([(*d, d[0]) for d in docs], "doc_id long, text string, source string, mix int, `a.b` long")
    out = mixing.mixed(df).collect()
    first = Counter((r.doc_id, r.text, r.source) for r in out if r.mix.copy == 0)
    assert first == Counter(d[:3] for d in docs)
    by_block = {}
    for r in out:
        by_block.setdefault((r.mix.source, r.mix.block, r.mix.copy), set()).add(r.mix.slot)
    assert all(len(x) == 1 for x in by_block.values())
    assert len({next(iter(x)) for x in by_block.values()}) == len(by_block)
    assert mixing.mixed(df.limit(0)).count() == 0
    own = mixing.stage(spark, df, "")
    assert own.columns == df.columns and {tuple(r) for r in own.collect()} == {(*d, d[0]) for d in docs}
    size = Counter(r.mix.source for r in out if r.mix.copy == 0)
    blocks = Counter((r.mix.source, r.mix.block) for r in out if r.mix.copy == 0)
    assert all(n == min(mixing.BLOCK_DOCS, size[s] - b * mixing.BLOCK_DOCS) for (s, b), n in blocks.items())
    many = spark.range(mixing.MAX_SOURCES + 1).selectExpr("id AS doc_id", "cast(id AS string) AS source")
    with pytest.raises(ValueError):
        mixing.mixed(many)


def test_copies_are_bounded(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "if(id % 10 = 0, 'small', 'big') AS source")
    weights = {"big": 0.05, "small": 0.95}
    assert mixing.mixed(df, weights).count() > 20_000
    out = mixing.mixed(df, weights, most_copies=3)
    assert out.count() == 2700 + 3 * 300 and out.select("doc_id").distinct().count() == 3000


def test_hot_null_ids_are_spread(spark):
    df = spark.range(20_000).selectExpr("if(id % 3 = 0, id, null) AS doc_id", "'s' AS source")
    rows, ranges = mixing.numbered(df, "doc_id", "source")
    assert max(r.n for r in ranges.collect()) < 6000
    numbers = mixing.mixed(df).where("mix.copy = 0").groupBy("mix.block").count().collect()
    assert sorted(r["count"] for r in numbers) == [20_000 % 64] + [64] * (20_000 // 64)


def test_any_number_of_sources(spark):
    n = {f"s{i}": 1 + i % 7 + (3000 if i == 5 else 200 if i % 50 == 0 else 0) for i in range(600)}
    docs = spark.createDataFrame([(f"{s}/{k}", s) for s, m in n.items() for k in range(m)], "doc_id string, source string")
    out = mixing.mixed_any(docs).collect()
    assert Counter(r.doc_id for r in out if r.mix.copy == 0) == Counter({f"{s}/{k}": 1 for s, m in n.items() for k in range(m)})
    slots = {}
    for r in out:
        slots.setdefault(r.mix.slot, set()).add((r.mix.source, r.mix.block, r.mix.copy))
    assert all(len(x) == 1 for x in slots.values())

    plan = mixing.schedule_in_groups(spark.createDataFrame(list(n.items()), "source string, n long")).collect()
    owner, end = {}, 0
    for r in plan:
        share, at = 1.0, []
        for x in r.levels:
            share *= x.parts / mixing.PERIOD
        for i in range(r.placed):
            t = i
            for x in r.levels:
                t = t // x.parts * mixing.PERIOD + x.slots[t % x.parts]
            assert owner.setdefault(t, r.source) == r.source
            at.append(t)
        assert r.placed >= r.blocks == -(-n[r.source] // mixing.BLOCK_DOCS) and at == sorted(at)
        assert all(i - 1e-9 - (t + 1) * share < 2 and (t + 1) * share - i - 1 < 2 for i, t in enumerate(at))
        end = max(end, at[-1] + 1)
    assert sorted(owner) == list(range(end)) and len(plan) == len(n)


def test_sql(spark):
    for sf in ("sf0.001", "sf0.01"):
        path = f"/root/testdata/{sf}"
        assert same(mixing.query(spark, path), mixing.SQL, path) >= 200
