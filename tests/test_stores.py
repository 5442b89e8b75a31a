"""Documents changed by patches, merged accounts, imports under new keys, and retention that is stopped halfway."""

import copy
import json
import random

import pytest
from pyspark.sql import functions as F

from quotalens.operators import accounts, documents, retention, rollup, transfer
from quotalens.plans import stores


def merge_patch(old, new):
    """RFC 7396, as its pseudo code has it."""
    if not isinstance(new, dict):
        return new
    old = dict(old) if isinstance(old, dict) else {}
    for k, v in new.items():
        if v is None:
            old.pop(k, None)
        else:
            old[k] = merge_patch(old.get(k), v)
    return old


def tree(rng, depth, nulls):
    if depth == 0 or rng.random() < 0.3:
        return rng.choice([1, 2.5, True, "x", "1", [1, {"a": None}], *([None] if nulls else [])])
    return {rng.choice("abc"): tree(rng, depth - 1, nulls) for _ in range(rng.randrange(4))}


def test_patches_keep_types_and_merge_nested_objects(spark):
    rng = random.Random(3)
    pairs = [({"k": tree(rng, 3, False)}, {"k": tree(rng, 3, True), "n": tree(rng, 2, True)}) for _ in range(150)]
    pairs += [({"a": 1}, {"a": {"b": {"c": None, "d": 1}}}), ({"a": 12345678901234567890, "b": 1e300}, {})]
    rows = [(k, json.dumps(a), json.dumps(b)) for k, (a, b) in enumerate(pairs)]
    got = spark.createDataFrame(rows, "id long, old string, new string").select("id", documents.patched(F.col("old"), F.col("new")).alias("v")).collect()
    for r in got:
        assert json.loads(r.v) == merge_patch(copy.deepcopy(pairs[r.id][0]), pairs[r.id][1]), pairs[r.id]
    assert any('"a":1' in r.v for r in got)


def test_odd_documents_and_patches(spark):
    rows = [("no json", '{"a":1}'), ("[1]", '{"a":1}'), ('{"a":1}', "no json"), ('{"a":1}', "[2]"), (None, '{"a":{"b":null}}'), ('{"a":1}', None), (None, None), ("{}", '{"":1}')]
    df = spark.createDataFrame(rows, "old string, new string")
    got = [r.v for r in df.select(documents.patched(F.col("old"), F.col("new")).alias("v")).collect()]
    assert got == ['{"a":1}', '{"a":1}', '{"a":1}', '{"a":1}', '{"a":{}}', '{"a":1}', "{}", '{"":1}']


@pytest.mark.parametrize("document, path, removed, set_", [
    ('{"a":{"b":1,"c":[1]},"d":2}', "a.b", '{"a":{"c":[1]},"d":2}', '{"a":{"b":7,"c":[1]},"d":2}'),
    ('{"a":{"b":1}}', "a", None, '{"a":7}'),
    ('{"a":1}', "a.b", '{"a":1}', '{"a":1}'),
    ('{"a":1}', "x.y", '{"a":1}', '{"a":1}'),
    ('{"a":1}', "z", '{"a":1}', '{"a":1,"z":7}'),
    ("[1]", "a", None, '{"a":7}'),
    (None, "a.b", None, "{}"),
])
def test_paths(spark, document, path, removed, set_):
    df = spark.createDataFrame([(document, 7)], "d string, n long")
    r = df.select(documents.without_keys(F.col("d"), path).alias("r"), documents.with_key(F.col("d"), path, F.col("n")).alias("s")).first()
    assert (r.r, r.s) == (removed, set_)


def test_merges_are_followed_in_time(spark):
    """Chains, accounts that come back, and cycles, against a walk from each fact."""
    rng = random.Random(8)
    merges = [(s, t, u) for s, t, u in ((rng.randrange(12), rng.randrange(12), rng.randrange(400)) for _ in range(120))] + [(3, 3, 5), (20, 21, 1), (21, 22, 1), (22, 23, 9), (None, 4, 7), (4, 5, None)]
    facts = [(k, rng.choice([*range(14), None, 20, 21]), rng.choice([None, *range(420)])) for k in range(600)]

    def walk(account, us):
        if account is None or us is None:
            return account
        strict = False
        while True:
            nexts = [(u, t) for s, t, u in merges if u is not None and s is not None and s == account and s != t and (u > us if strict else u >= us)]
            if not nexts:
                return account
            us, account = min(nexts)
            strict = True

    got = accounts.resolved(spark.createDataFrame(facts, "id long, account_id long, us long"), spark.createDataFrame(merges, "source long, target long, us long")).collect()
    assert {r.id: r.resolved for r in got} == {k: walk(a, u) for k, a, u in facts} and len(got) == len(facts)


def test_long_chain_of_merges(spark):
    n = 500
    merges = spark.createDataFrame([(k, k + 1, k) for k in range(n)], "source long, target long, us long")
    assert {r.survivor for r in accounts.merge_ends(merges).collect()} == {n}
    assert accounts.merge_ends(merges.where("us < 0")).count() == 0


GRAPH = [
    transfer.Table("samples", "id", ("account", "at"), {"account": "accounts"}),
    transfer.Table("accounts", "id", ("provider", "name"), {"provider": "providers"}),
    transfer.Table("providers", "id", ("name",)),
    transfer.Table("notes", "id", (), {"sample": "samples"}),
]


def store(spark, providers, accounts_, samples, notes):
    return {
        "providers": spark.createDataFrame(providers, "id long, name string"), "accounts": spark.createDataFrame(accounts_, "id long, provider long, name string"),
        "samples": spark.createDataFrame(samples, "id long, account long, at long, used int"), "notes": spark.createDataFrame(notes, "id long, sample long, text string"),
    }


def test_import_is_idempotent_and_follows_references(spark):
    here = store(spark, [(1, "p"), (2, "q")], [(1, 1, "a"), (7, 2, "b")], [(1, 1, 10, 5)], [(1, 1, "mine")])
    there = store(
        spark, [(1, "q"), (2, "r"), (3, None)], [(5, 1, "b"), (6, 2, "c"), (9, 99, "orphan"), (10, None, "free")],
        [(1, 5, 10, 1), (2, 6, 11, 2), (3, 9, 12, 3), (4, None, 13, 4), (5, 6, 11, 9)], [(4, 2, "x"), (2, 2, "x"), (3, 3, "of an orphan"), (8, 5, "of a twin")],
    )
    none = spark.createDataFrame([], transfer.PROVENANCE)
    added, origins = transfer.imported(here, there, GRAPH, "laptop", none)
    rows = {n: sorted(map(tuple, df.collect()), key=str) for n, df in added.items()}
    assert rows["providers"] == [(3, "r"), (4, None)]
    assert rows["accounts"] == [(8, 3, "c"), (9, None, "free")]  # b of q is account 7 here
    assert rows["samples"] == [(2, 7, 10, 1), (3, 8, 11, 2), (4, None, 13, 4)]  # 5 is the twin of 2
    assert rows["notes"] == [(2, 3, "x"), (3, 3, "x"), (4, 3, "of a twin")]
    now = {n: here[n].unionByName(added[n]) for n in here}
    again, more = transfer.imported(now, there, GRAPH, "laptop", origins)
    assert more.count() == 0 and all(df.count() == 0 for df in again.values())
    other, more = transfer.imported(now, there, GRAPH, "desktop", origins)  # the same rows from another store: notes have no natural key
    assert {n: df.count() for n, df in other.items()} == {"providers": 1, "accounts": 1, "samples": 1, "notes": 3} and more.count() > 0


def test_import_in_two_parts(spark):
    here = store(spark, [], [], [], [])
    full = store(spark, [(70_000, "p"), (5, "q")], [(3, 5, "a"), (200_000, 70_000, "b")], [(9, 200_000, 1, 1), (10, 3, 1, 2)], [])
    part = dict(full, samples=full["samples"].where("false"))
    none = spark.createDataFrame([], transfer.PROVENANCE)
    added, origins = transfer.imported(here, part, GRAPH, "o", none)
    now = {n: here[n].unionByName(added[n]) for n in here}
    more, _ = transfer.imported(now, full, GRAPH, "o", origins)
    assert sorted(map(tuple, now["accounts"].collect())) == [(1, 1, "a"), (2, 2, "b")] and sorted(map(tuple, more["samples"].collect())) == [(1, 2, 1, 1), (2, 1, 1, 2)]
    assert more["providers"].count() == more["accounts"].count() == 0
    with pytest.raises(ValueError, match="circle"):
        transfer.imported(here, full, [transfer.Table("providers", "id", (), {"name": "providers"})], "o", none)


EVENTS = "fingerprint string, event_id long, us long, " + ", ".join(f"{d} string" for d in rollup.DIMENSIONS) + ", " + ", ".join(f"{t} long" for t in rollup.TOKENS) + ", cost_cents long"
HOUR = rollup.HOUR_US


def events(first, n, hours=(0, 6), seed=0):
    rng = random.Random(seed)
    rows = []
    for k in range(first, first + n):
        us = rng.randrange(hours[0] * HOUR, hours[1] * HOUR)
        rows.append((f"f{k}", k, us, *[rng.choice(["x", "y"]) for _ in rollup.DIMENSIONS], *[rng.randrange(100) for _ in rollup.TOKENS], rng.choice([None, 1, 2])))
    return rows


def sums(df):
    return tuple(df.agg(*rollup.remeasures()).first())


@pytest.mark.parametrize("seed", range(3))
def test_retention_stopped_anywhere_loses_and_doubles_nothing(spark, tmp_path, seed):
    rng = random.Random(seed)
    s = retention.Store(spark, str(tmp_path / "store"), EVENTS, HOUR)
    all_rows = []
    for run in range(5):
        new = events(1000 * run, 60, seed=10 * seed + run)
        all_rows += new
        s.add_events(spark.createDataFrame(new, EVENTS))
        s.compact(4 * HOUR, f"run{run}", until=rng.choice(retention.STEPS))
        whole = rollup.with_archive(spark.createDataFrame(all_rows, EVENTS), s.archive().where("false"))
        assert sums(s.usage()) == sums(whole)
    assert s.compact(4 * HOUR, "last") == []
    assert sums(s.usage()) == sums(whole)
    assert s.events().where(F.col("part_us") < 4 * HOUR).count() == 0 and s.events().count() == len([r for r in all_rows if r[2] >= 4 * HOUR])
    s.add_events(spark.createDataFrame(all_rows[:50], EVENTS))  # replays of compacted and of other events
    kept = [r for r in all_rows[:50] if r[2] >= 4 * HOUR]
    assert s.compact(4 * HOUR, "replay") == []
    assert s.events().count() == len([r for r in all_rows if r[2] >= 4 * HOUR]) + len(kept)


def test_retention_keeps_what_does_not_add_up(spark, tmp_path):
    s = retention.Store(spark, str(tmp_path / "store"), EVENTS, HOUR)
    rows = events(0, 50, (0, 2))
    s.add_events(spark.createDataFrame(rows, EVENTS))
    s.compact(2 * HOUR, "a", until="tombstones")
    lost = [r for r in rows if r[2] < HOUR][0]
    s._write(spark.createDataFrame([r for r in rows if r[2] < HOUR and r != lost], EVENTS).withColumn("part_us", F.lit(0).cast("long")), "events", "part_us")
    assert s.compact(2 * HOUR, "b") == [(0, "a")]
    assert s.events().count() == len([r for r in rows if r[2] < HOUR]) - 1 and s.usage().agg(F.sum("request_count")).first()[0] == 49


def test_retention_of_nothing(spark, tmp_path):
    s = retention.Store(spark, str(tmp_path / "store"), EVENTS, HOUR)
    assert s.compact(HOUR, "a") == [] and s.usage().count() == 0


def test_merges_are_carried_over_spans_in_linear_work(spark):
    """Facts whose next merge is spans away; no frame runs to a partition's end, which Spark evaluates anew for each row."""
    day, rng = 86_400_000_000, random.Random(4)
    merges = [(1, 2, 3 * day), (2, 1, 5 * day), (1, 3, 9 * day), (3, 4, 9 * day + 1)]
    facts = [(k, rng.choice([1, 2, 3, 9, None]), rng.choice([None, 0, 3 * day, 9 * day, rng.randrange(-day, 10 * day)])) for k in range(300)]

    def walk(account, us, strict=False):
        nexts = [(u, t) for s, t, u in merges if s == account and us is not None and (u > us if strict else u >= us)]
        return walk(min(nexts)[1], min(nexts)[0], True) if nexts else account

    found = accounts.resolved(spark.createDataFrame(facts, "id long, account_id long, us long"), spark.createDataFrame(merges, "source long, target long, us long"))
    assert {r.id: r.resolved for r in found.collect()} == {k: walk(a, u) for k, a, u in facts}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "unboundedfollowing" not in plan and "_span" in plan


def test_json_changes_work_on_all_cores(spark, tmp_path):
    """One file of one row group is one task of a scan."""
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    made = stores.QUERIES["json_changes"][0](spark, str(tmp_path))
    sizes = [n for n in made.select("event_id").rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert len(sizes) >= spark.sparkContext.defaultParallelism and sum(sizes) == spark.read.parquet(str(tmp_path / "events.parquet")).count()
