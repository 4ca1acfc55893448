import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from filewright.operators import copies, lookups, rules, sequences, state, summaries

def now():
    return F.lit("2024-03-01 00:00:00").cast("timestamp")


def item(name, bytes_=10, days=0):
    return (name, name, "." + name.rpartition(".")[2].lower(), bytes_, days)


@pytest.mark.parametrize(
    ("file", "kinds"),
    [
        (item("a.part", 5, 0), set()), (item("a.part", 5, 1), {"partial"}), (item("a.tmp", 0, 8), {"empty"}), (item("a.tmp", 1, 6), set()),
        (item("a.tmp", 1, 7), {"temp"}), (item("a.exe", 1, 13), set()), (item("a.exe", 1, 14), {"installer", "old-download"}),
        (item("a.zip", 1, 29), {"old-download"}), (item("a.zip", 1, 30), {"archive", "old-download"}), (item("a.pages", 1, 99), set()),
        (item("Screenshot 1.png", 1, 30), {"screenshot-noise", "old-download"}), (item("截圖1.png", 1, 29), {"old-download"}),
        (item("a.pem", 1, 99), set()), (item(".x.zip", 1, 99), set()), (item("token", 0, 99), set()), (item("token.txt", 0, 99), {"empty", "old-download"}),
    ],
)
def test_rule_boundaries(spark, file, kinds):
    frame = spark.createDataFrame([file], "id string, name string, ext string, bytes long, days int").withColumn("mtime", F.timestamp_add("DAY", -F.col("days"), now()))
    got = rules.candidates(frame, now()).collect()
    assert {r.kind for r in got} == kinds and all(r.confidence == rules.CONFIDENCE[r.kind] for r in got)


@pytest.mark.parametrize("bad", [0, -1, float("nan"), None])
def test_bad_protect_days_fall_back(spark, bad):
    frame = spark.createDataFrame([(1, "a.pdf", ".pdf", 9)], "id int, name string, ext string, bytes long").withColumn("mtime", F.timestamp_add("DAY", F.lit(-13), now()))
    assert rules.candidates(frame, now(), bad).count() == 0
    assert rules.candidates(frame, now(), 13).count() == 1


def test_keeper_prefers_first_seen_then_the_original_name(spark):
    rows = [("1", "r (1).pdf", "/a/r (1).pdf", 5, "h", None), ("2", "r.pdf", "/a/r.pdf", 5, "h", None), ("3", "x.pdf", "/a/x.pdf", 9, "h", None), ("4", "y", "/a/y", 1, None, None), ("5", "z", "/a/z", 1, None, "t" * 200), ("6", "w", "/a/w", 2, "q", "t" * 200), ("7", "v", "/a/v", 3, "q2", "t" * 199)]
    items = spark.createDataFrame(rows, "id string, name string, path string, first_seen_at int, sha256 string, text string")
    assert sorted(tuple(r) for r in copies.exact(items).collect()) == [("1", "2", 3), ("3", "2", 3)]
    assert sorted(tuple(r) for r in copies.same_text(items).collect()) == [("6", "5", 2)]
    assert {tuple(r) for r in copies.keeper_survives(spark.createDataFrame([("1",), ("4",), ("6",)], "id string"), items.select("id", "sha256")).collect()} == {("1", True), ("4", False), ("6", False)}


def test_capacity_chunks_match_a_loop(spark):
    rng = random.Random(1)
    rows = [(g, o, rng.randint(1, 60)) for g in range(3) for o in range(50)]
    want = {}
    for g in range(3):
        chunk = total = n = 0
        for _, o, w in (r for r in rows if r[0] == g):
            if n and (total + w > 100 or n >= 4):
                chunk, total, n = chunk + 1, 0, 0
            total, n = total + w, n + 1
            want[g, o] = chunk
    got = sequences.capacity_chunks(spark.createDataFrame(rows, "g int, o int, w int"), "g", "o", "w", 100, 4).collect()
    assert {(r.g, r.o): r.chunk for r in got} == want


def test_leaders_match_a_slow_model_and_are_not_transitive(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(6)]
    rows = []
    for n in range(120):
        s = rng.choice(base)
        for _ in range(rng.randint(0, 8)):
            s ^= 1 << rng.randrange(64)
        rows.append((n % 2, n, rng.randint(0, 900), int(np.uint64(s).astype(np.int64))))
    frame = spark.createDataFrame(rows, "d int, id int, t int, s long").withColumn("at", F.timestamp_seconds("t"))
    got = {r.id: r.leader for r in sequences.leaders(frame, ["d"], "id", "at", "s", 10, 300).collect()}
    want = {}
    for d in (0, 1):
        leads = []
        for _, i, t, s in sorted((r for r in rows if r[0] == d), key=lambda r: (-r[2], r[1])):
            for li, lt, ls in leads:
                if lt - t <= 300 and bin((ls ^ s) & (2**64 - 1)).count("1") <= 10:
                    want[i] = li
                    break
            else:
                leads.append((i, t, s))
                want[i] = i
    assert got == want


def test_interval_pairs_include_the_exact_gap_and_order_ties(spark):
    rows = [(1, "a", 0, 0), (2, "a", 300_000_000, 0), (3, "a", 600_000_001, 0), (4, "a", 0, 0), (5, "b", 0, 0)]
    frame = spark.createDataFrame(rows, "id int, d string, t long, s long").withColumn("at", F.timestamp_micros("t"))
    got = {(r.a, r.b) for r in lookups.within(frame, ["d"], "id", "at", 300).collect()}
    assert got == {(1, 2), (4, 2), (1, 4)}
    near = lookups.within(frame.withColumn("s", F.when(F.col("id") == 2, 2**12 - 1).otherwise(0)), ["d"], "id", "at", 300, "s", 10)
    assert {(r.a, r.b) for r in near.collect()} == {(1, 4)}


def test_outcomes_and_plan_states(spark):
    done = [("p1", "a", "quarantine", "done"), ("p1", "b", "quarantine", "done"), ("p1", "b", "restore", "done"), ("p2", "c", "quarantine", "failed"), ("p2", "d", "quarantine", "done"), ("p3", "e", "quarantine", "started"), ("p4", "f", "skip", "done"), ("p5", "g", "quarantine", "failed"), ("p5", "g", "quarantine", "done"), ("p5", "g", "purge", "done"), ("p6", "h", "quarantine", "done"), ("p6", "h", "restore", "done")]
    told = state.outcomes(spark.createDataFrame([(n, *r) for n, r in enumerate(done)], "seq int, plan_id string, item_id string, op string, status string"))
    assert {r.item_id: r.outcome for r in told.collect()} == {"a": "moved", "b": "restored", "c": "failed", "d": "moved", "e": "unfinished", "f": "skipped", "g": "purged", "h": "restored"}
    assert {r.plan_id: r.status for r in state.settle_plans(told).collect()} == {"p1": "applied", "p2": "partial", "p3": "unresolved", "p4": "proposed", "p5": "applied", "p6": "restored"}


def test_retention_paging_and_guards(spark):
    rows = spark.range(45).select(F.col("id"), (F.col("id") % 3).alias("at"))
    assert [r.id for r in state.page(rows, ["id"], 1000, 20).collect()] == [40, 41, 42, 43, 44]
    assert len(state.page(rows, ["id"], 0, 0).collect()) == 1
    assert state.missing(rows, rows.limit(0), "id").count() == 0
    assert state.missing(rows.limit(3), rows.limit(0), "id").count() == 3
    assert sorted(r.id for r in state.newest(rows, "at", "id", 3).collect()) == [2, 5, 8]


def test_groups_are_claimed_once_and_matched_by_the_best_alias(spark):
    answers = spark.createDataFrame([(0, "A", [0, 1, 1, 9]), (1, "B", [1, 2]), (2, "C", [0])], "ord int, name string, members array<int>")
    assert sorted(tuple(r) for r in summaries.claim_first(answers, 5).collect()) == [(0, "A", [0, 1]), (1, "B", [2])]
    labels = spark.createDataFrame([(1, "yourfirstname"), (2, "name"), (3, "zip"), (4, ""), (5, None)], "id int, label string")
    registry = spark.createDataFrame([("first", "firstname", 0), ("full", "name", 1)], "name string, alias string, ord int")
    assert sorted(tuple(r) for r in lookups.alias_match(labels, registry, "id", "label").collect()) == [(1, "first", False), (2, "full", True)]
