"""The operators on histories: cases by hand, random histories against plain loops, cut-off streams."""

import doctest
import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from filewright.functions import untitled
from filewright.operators import admission, facts, filing, groups, health, identity, learned, lookups, sequences, validation
from filewright.streaming import intake, sink

COMMANDS = "owner string, seq long, op string, fact_id long, key string, value string, n int, kind string, k string, v string, status string"


def test_doctests():
    assert sum(doctest.testmod(m).failed for m in (facts, intake)) == 0


# --- facts ---


def naive_facts(commands):
    """Whole snapshots before each command, as an undo log keeps them."""
    rows, log = {}, []
    for _, seq, op, fact, key, value, n, *_ in commands:
        before = {k: dict(v) for k, v in rows.items()}
        if op == "undo":
            for _ in range(min(n, len(log))):
                rows = log.pop()
            continue
        if op in ("propose", "manual") and fact is not None and fact not in rows:
            rows[fact] = {"key": key, "value": value, "status": "candidate", "supersedes": None, "seq": seq}
            log.append(before)
            before = {k: dict(v) for k, v in rows.items()}
        elif op == "reject" and fact in rows:
            rows[fact] |= {"status": "rejected", "seq": seq}
            log.append(before)
            continue
        elif op != "confirm":
            continue
        if op in ("confirm", "manual") and fact in rows and rows[fact]["status"] == "candidate" and (op == "confirm" or rows[fact]["seq"] == seq):
            old = [i for i, r in rows.items() if r["key"] == rows[fact]["key"] and r["status"] == "confirmed"]
            for i in old:
                rows[i]["status"] = "superseded"
            rows[fact] |= {"status": "confirmed", "supersedes": old[0] if old else None, "seq": seq}
            log.append(before)
    return {(i, r["key"], r["value"], r["status"], r["supersedes"]) for i, r in rows.items()}


def test_facts_match_snapshots(spark):
    rng, rows = random.Random(3), []
    for owner in ("a", "b", None, "long"):
        for seq in range(400 if owner == "long" else 60):
            op = rng.choice(["propose", "propose", "confirm", "confirm", "manual", "reject", "undo", "what"])
            rows.append((owner, seq, op, rng.choice([None, *range(12)]), rng.choice("xy"), f"v{seq}", rng.randint(0, 3)))
    frame = spark.createDataFrame([(*r, None, None, None, "clash") for r in rows], COMMANDS).repartition(5)
    got = facts.history(frame).collect()
    for owner in ("a", "b", None, "long"):
        assert {(r.fact_id, r.key, r.value, r.status, r.supersedes) for r in got if r.owner == owner} == naive_facts([r for r in rows if r[0] == owner])
    assert facts.history(frame.limit(0)).count() == 0
    assert {r.fact_id for r in facts.current(facts.history(frame)).collect()} == {r.fact_id for r in got if r.status == "confirmed"}


# --- learned preferences ---


def naive_store(commands, keep):
    rows, evicted = {}, 0
    for _, seq, op, kind, k, v in commands:
        key = ("rejected" if op == "reject" else kind, k)
        if op == "clear":
            rows, evicted = {}, 0
        elif op == "forget":
            rows.pop(key, None)
        elif k and (op == "reject" or v):
            old = rows.get(key)
            rows[key] = ("" if op == "reject" else v, old[1] + 1 if old else 1, seq, old[3] if old else seq)
            if len(rows) > keep:
                low = min((x for x in rows if x != key), key=lambda x: (x[0] != "rejected", *rows[x][1:]))
                del rows[low]
                evicted += 1
    return {(*k, *v, evicted) for k, v in rows.items()}


def test_preferences_match_a_scan_at_each_step(spark):
    rng = random.Random(5)
    rows = [("a" if rng.random() < 0.8 else None, seq, rng.choice(["learn"] * 6 + ["reject"] * 2 + ["forget"] + ["clear"] * (rng.random() < 0.05)), rng.choice(["course", "file_kind"]), rng.choice(["", None, *map(str, range(15))]), rng.choice(["", "u", "w"])) for seq in range(900)]
    frame = spark.createDataFrame([(o, s, op, None, None, None, None, kind, k, v, "x") for o, s, op, kind, k, v in rows], COMMANDS).repartition(3)
    got = learned.learned(frame, 7).collect()
    for owner in ("a", None):
        assert {tuple(r)[1:] for r in got if r.owner == owner} == naive_store([r for r in rows if r[0] == owner], 7)
    assert learned.learned(frame.limit(0)).count() == 0
    ranks = [r for r in learned.ranked(learned.learned(frame, 7)).collect() if r.owner == "a"]
    assert [r["rank"] for r in sorted(ranks, key=lambda r: (-r.times, -r["at"]))] == list(range(1, len(ranks) + 1))


# --- plans ---


def naive_plans(requests, listing):
    held, known, out = {}, {}, []
    for seq, rid, ids in sorted(requests):
        wanted = sorted({x for x in ids or [] if x is not None})
        items = {listing[x] for x in wanted if x in listing}
        if rid is not None and rid in known:
            status, plan = ("repeated" if known[rid][0] == wanted else "request conflict"), known[rid][1]
        elif any(x not in listing for x in wanted):
            status, plan = "stale", None
        elif not items:
            status, plan = "empty", None
        elif items & held.keys():
            status, plan = "conflict", min(held[x] for x in items & held.keys())
        else:
            status, plan = "accepted", seq
            held |= dict.fromkeys(items, seq)
            if rid is not None:
                known[rid] = (wanted, seq)
        out.append((seq, rid, status, plan, len(items)))
    return out


def test_plans_match_one_by_one(spark):
    rng = random.Random(8)
    listing = {n: n // 2 for n in range(60)}
    requests = [(seq, rng.choice([None, None, f"r{rng.randint(0, 9)}"]), rng.choice([None, [], [rng.randint(0, 61) for _ in range(rng.randint(1, 3))], [None, 4], [5, 4, 4]])) for seq in range(90)]
    requests += [(-2, "again", [58]), (-1, "again", [58, 58]), (95, "again", [57])]
    requests += [(1000 + n, None, [40 + n, 41 + n]) for n in range(12)]  # a chain in which each waits for the one before
    frame = spark.createDataFrame([(*r, 1, "x") for r in requests], "seq long, request_id string, ids array<long>, key int, item string")
    here = spark.createDataFrame(list(listing.items()), "id long, item long")
    got = sorted(tuple(r) for r in admission.admitted(frame, here).collect())
    assert got == naive_plans(requests, listing)
    assert {x[2] for x in got} == {"accepted", "conflict", "repeated", "request conflict", "stale", "empty"}
    assert admission.admitted(frame.limit(0), here).count() == 0


def test_items_that_one_request_alone_wants_leave_the_rounds(spark):
    wants = spark.createDataFrame([(seq, f"own {seq}") for seq in range(500)] + [(seq, "hot") for seq in range(20, 60)] + [(30, "two"), (600, "two"), (59, "end"), (700, "end")], "seq long, key string")
    contested = admission.shared(wants)
    assert contested.count() == 44
    assert {r.first for r in contested.where("key = 'hot'").collect()} == {20}
    # 30 is refused for 20's sake, so that its other key goes to 600
    assert sorted(r.seq for r in admission.refused(contested).collect()) == list(range(21, 60))
    assert admission.refused(admission.shared(wants.where("key like 'own%'"))).count() == 0


def test_many_plans_for_few_items_match_one_by_one(spark):
    rng = random.Random(3)
    listing = {n: min(n % 50, 40) for n in range(200)}
    requests = [(seq, rng.choice([None, f"r{rng.randint(0, 150)}"]), rng.sample(range(201), rng.randint(0, 3)) or None) for seq in range(400)]
    frame = spark.createDataFrame(requests, "seq long, request_id string, ids array<long>")
    got = sorted(tuple(r) for r in admission.admitted(frame, spark.createDataFrame(list(listing.items()), "id long, item long")).collect())
    assert got == naive_plans(requests, listing)


# --- identity ---


def test_identities_match_a_map_of_paths(spark):
    rng = random.Random(2)
    catalogue = [(n, f"p{n}") for n in range(0, 40, 2)]
    renames = [(seq, rng.choice([None, *(f"p{n}" for n in range(40))]), f"p{rng.randint(0, 39)}") for seq in range(150)]
    renames += [(200 + n, f"q{n}", f"q{n + 1}") for n in range(70)]  # one file along a chain
    at = {p: ("item", i) for i, p in catalogue}
    for seq, source, target in renames:
        if source and source != target:
            moved = at.pop(source, ("born", seq))
            at.setdefault(target, moved)
    want = sorted((p, i if kind == "item" else None, i if kind == "born" else None, "live") for p, (kind, i) in at.items())
    want += sorted((p, i, None, "missing") for i, p in catalogue if ("item", i) not in at.values())
    known = spark.createDataFrame([(i, p, "x") for i, p in catalogue], "item long, path string, status string")
    moves = spark.createDataFrame([(*r, 1) for r in renames], "seq long, source string, target string, span int")
    for block in (1 << 16, 7):
        assert sorted((tuple(r) for r in identity.followed(known, moves, block).collect()), key=str) == sorted(want, key=str)
    assert sorted(tuple(r) for r in identity.followed(known, moves.limit(0)).collect()) == [(p, i, None, "live") for p, i in sorted((p, i) for i, p in catalogue)]
    assert identity.followed(known.limit(0), moves.limit(0)).count() == 0


def test_capacity_chunks_stream_a_group(spark):
    rng = random.Random(1)
    rows = [(g, n, rng.choice([1, 5, 40, 200, None])) for g in ("a", None) for n in range(300)]
    got = sequences.capacity_chunks(spark.createDataFrame(rows, "g string, n int, w int").repartition(4), "g", "n", "w", 100, 8).collect()
    for g in ("a", None):
        chunk = total = count = 0
        want = []
        for _, n, w in (r for r in rows if r[0] == g):
            if count and (total + (w or 0) > 100 or count >= 8):
                chunk, total, count = chunk + 1, 0, 0
            total, count = total + (w or 0), count + 1
            want.append((n, chunk))
        assert sorted((r.n, r.chunk) for r in got if r.g == g) == want


# --- streams ---

START = datetime(2024, 1, 1, tzinfo=UTC)
LIMITS = intake.Limits(settle=1000, retry=5000, remember=600_000)


def observed(spark, rows):
    return spark.createDataFrame([(p, s, m, g, v, START + timedelta(milliseconds=t)) for p, s, m, g, v, t in rows], intake.OBSERVED)


def naive_intake(rows, there):
    out = []
    for path in {r[0] for r in rows if r[0]}:
        state = (1, 1, int(START.timestamp() * 1000) + LIMITS.remember, *intake.EMPTY[3:]) if path in there else intake.EMPTY
        for _, size, mtime, gone, verdict, t in sorted((r for r in rows if r[0] == path), key=lambda r: (r[5], r[1], r[2])):
            at = int(START.timestamp() * 1000) + t
            state, found = intake.fire(state, at, LIMITS)
            out += [(path, *x) for x in found]
            state = intake.observe(state, size, mtime, gone, verdict, at, LIMITS)
        out += [(path, *x) for x in intake.fire(state, 10**15, LIMITS)[1]]
    return sorted(out)


@pytest.mark.parametrize("files", [1, 4])
def test_intake_is_the_same_in_any_batches_and_leaves_no_state(spark, tmp_path, files):
    rng, now = random.Random(9), int(START.timestamp() * 1000)
    rows = [(rng.choice(["a", "b", "c", "old", None]), rng.randint(1, 2), now + rng.randint(0, 2), rng.random() < 0.1, rng.choice(["ok", "ok", "never", "later", "later"]), t * 700) for t in range(160)]
    rows += [("there", 1, 1, False, "ok", 10), ("there", 1, 1, False, "ok", 4000), ("ancient", 5, now - 900_000, False, "ok", 20)]
    rows.sort(key=lambda r: r[5])
    parts = [rows[len(rows) * n // files : len(rows) * (n + 1) // files] for n in range(files)] + [[("~", 1, 1, True, "ok", 10**9)]]
    for n, part in enumerate(parts):
        observed(spark, part).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    there = spark.createDataFrame([("there", 1, 1, START), ("old", 1, 1, START)], intake.SEEN)
    stream = spark.readStream.schema(intake.OBSERVED).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got, checkpoint = intake.replayed(spark, stream, there, LIMITS)
    assert sorted(tuple(r) for r in got.collect()) == naive_intake(rows, {"there", "old"})
    assert spark.read.format("statestore").option("stateVarName", "path").load(checkpoint.removeprefix("file://")).count() == 0


def intake_rows(spark, folder, groups):
    rng, now = random.Random(5), int(START.timestamp() * 1000)
    rows = [(f"f{rng.randint(0, 30)}", rng.randint(1, 2), now + rng.randint(0, 2), rng.random() < 0.1, rng.choice(["ok", "never", "later"]), t * 300) for t in range(600)]
    for n, part in enumerate([rows[:200], rows[200:], [("~", 1, 1, True, "ok", 10**9)]]):
        observed(spark, part).coalesce(1).write.parquet(f"{folder}/in/{n}")
    there = spark.createDataFrame([(f"f{n}", 1, 1, START) for n in range(0, 40, 3)], intake.SEEN)
    stream = spark.readStream.schema(intake.OBSERVED).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    got, checkpoint = intake.replayed(spark, stream, there, LIMITS, groups=groups)
    left = spark.read.format("statestore").option("stateVarName", "path").load(checkpoint.removeprefix("file://")).count()
    return sorted(tuple(r) for r in got.collect()), naive_intake(rows, {f"f{n}" for n in range(0, 40, 3)}), left


@pytest.mark.parametrize("groups", [1, 7])
def test_paths_that_share_a_state_and_a_timer_do_not_mix(spark, tmp_path, groups):
    got, want, left = intake_rows(spark, tmp_path, groups)
    assert got == want and len(got) > 100
    assert left == 0


class Store:
    """A state store that counts the calls."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def __getattribute__(self, name):
        if name in ("exists", "get", "update", "clear", "registerTimer", "deleteTimer"):
            self.calls += 1
        return super().__getattribute__(name)

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.remove(at)


def test_the_calls_to_the_state_store_do_not_grow_with_the_paths():
    one, store = intake.Intake(LIMITS, None), Store()
    one.init(store)
    rows = [Row(path=f"f{n}", size=1, mtime=10**13, gone=False, verdict="ok", at=START + timedelta(milliseconds=n)) for n in range(100)]
    assert list(one.handleInputRows((0,), iter(rows), None)) == []
    assert store.calls <= 5 and len(store.timers) == 1
    again = [Row(**(r.asDict() | {"at": r.at + timedelta(hours=1)})) for r in rows]
    assert [r.outcome for r in one.handleInputRows((0,), iter(again), None)] == ["accepted"] * 100
    assert store.calls <= 10 and len(store.timers) == 1


def test_a_file_is_tried_five_times_and_a_change_starts_anew():
    seen, out = intake.EMPTY, []
    now = 10**12
    seen = intake.observe(seen, 5, now, False, "later", now, LIMITS)
    seen, out = intake.fire(seen, now + 1000 + 3 * 5000, LIMITS)
    assert out == [] and seen[-1] == 4
    seen = intake.observe(seen, 6, now + 1, False, "ok", now + 17_000, LIMITS)
    seen, out = intake.fire(seen, now + 18_000, LIMITS)
    assert out == [(6, now + 1, "accepted", 5, now + 18_000)]
    assert intake.observe(seen, 6, now + 1, False, "ok", now + 19_000, LIMITS) == seen  # it is known


def test_killing_between_write_and_commit_changes_nothing(spark, tmp_path):
    for n in range(4):
        spark.range(n * 10, n * 10 + 10, 1, 2).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    died = []

    def die(epoch):
        if epoch in (0, 2) and epoch not in died:
            died.append(epoch)
            raise RuntimeError("killed after the write")

    for _ in range(3):
        query = sink.epochs(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint", die)
        try:
            query.awaitTermination()
            break
        except Exception as e:  # noqa: BLE001
            assert "killed after the write" in str(e)
    assert died == [0, 2]
    assert sorted(r.id for r in sink.committed(spark, f"{tmp_path}/out", stream.schema).collect()) == list(range(40))


def test_recovery_settles_what_is_certain_and_is_idempotent(spark):
    rows = [(1, "quarantine", "m"), (2, "quarantine", "m"), (3, "quarantine", "m"), (4, "restore", "m"), (5, "restore", "m"), (6, "quarantine", None), (7, "quarantine", "m")]
    journal = spark.createDataFrame([(i, 9, i, op, "started", m) for i, op, m in rows] + [(8, 9, 8, "restore", "done", "m")], "seq long, plan_id long, item_id long, op string, status string, mark string")
    found = spark.createDataFrame([(1, "quarantine", "m"), (2, "origin", "m"), (2, "quarantine", None), (3, "origin", "m"), (3, "quarantine", "other"), (4, "origin", "m"), (5, "quarantine", "m"), (6, "origin", None)], "item_id long, place string, mark string")
    got = {r.seq: r.status for r in sink.recovered(journal, found).collect()}
    assert got == {1: "done", 2: "reverted", 3: "started", 4: "done", 5: "failed", 6: "started", 7: "started"}
    again = journal.drop("status").join(sink.recovered(journal, found).select("seq", "status"), "seq").select(journal.columns)
    assert {r.seq for r in sink.recovered(again, found).collect()} == {3, 6, 7}


# --- names ---


def test_word_runs_match_a_plain_fold(spark):
    rng, words = random.Random(4), ["a", "ab", "ba", "bba", "aaaa"]

    def plain(run):
        reached = {0}
        for i in range(len(run)):
            if i in reached:
                reached |= {i + len(w) for w in words if run.startswith(w, i)}
        return len(run) in reached

    runs = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 12))) for _ in range(300)]
    got = spark.createDataFrame([(r,) for r in runs], "run string").select("run", untitled.is_word_run(F.col("run"), words).alias("x")).collect()
    assert all(r.x == plain(r.run) for r in got) and 0 < sum(r.x for r in got) < len(got)


def test_name_classes_by_hand(spark):
    cases = {
        None: None, "": ("untitled", "empty"), "   ": ("untitled", "empty"), "README": ("named", "named"), "a" * 140_000: ("generic", "too long"),
        "Thumbs.db": ("named", "temporary"), "IMG_2041.Java.jpg": ("named", "named"), "IMG_2041.jpg.part": ("untitled", "camera"), "Untitled.tar.gz": ("untitled", "untitled word"),
        "Screenshotat 2026.png": ("named", "named"), "signal-3.png": ("named", "named"), "WhatsApp Image 2026-09-17 at 14.12.03.jpeg": ("untitled", "messenger"),
        "2026-09-19 14-12-03 的螢幕擷圖 - 2.png": ("untitled", "screenshot"), "me.and.mom": ("named", "named"), "報告 - 副本 (2) - 複製.docx": ("generic", "general words"),
        "第十二版.pdf": ("generic", "general words"), "v1.2.3.txt": ("generic", "general words"), "notes notes notes notes notes notes notes notes notes.txt": ("named", "named"), "​‮.txt": ("untitled", "empty"),
        "123e4567-e89b-12d3-a456-426614174000": ("untitled", "uuid"), "photocopy": ("generic", "general words"), "telecopy": ("named", "named"), "GMT20260919-061203_Recording_1920x1080.mp4": ("untitled", "recording"),
    }
    frame = spark.createDataFrame([(n,) for n in cases], "name string")
    got = {r["name"]: r.c and tuple(r.c) for r in frame.select("name", untitled.name_class(F.col("name")).alias("c")).collect()}
    assert got == cases


# --- validation, groups and health ---

REGISTRY = "key string, type string, allowed array<string>, repeatable boolean, sensitivity string"


def test_a_registry_with_a_key_twice_fails_the_plan(spark):
    keys = spark.createDataFrame([("a", "string", None, False, "normal"), ("a", "date", None, False, "normal"), ("b", "text", None, False, "normal")], REGISTRY)
    rows = spark.createDataFrame([("b", "x")], "key string, value string")
    with pytest.raises(Exception, match="more than once"):
        validation.vetted(rows, keys).collect()
    one = validation.vetted(rows, keys.where("key = 'b'")).collect()
    assert [(r.normal, r.problems) for r in one] == [("x", [])]
    assert validation.vetted(rows.limit(0), keys.limit(0)).count() == 0
    index = validation.alias_index(spark.createDataFrame([("k1", 2, ["Name:", "Ｎame"]), ("k2", 1, ["name", " "])], "key string, ord int, aliases array<string>"), "aliases", "key", "ord")
    assert [tuple(r) for r in index.collect()] == [("name", "k2")]


def test_numbers_and_addresses(spark):
    cases = {"１２": 12.0, " 1e3 ": 1000.0, "1,5": None, "": None, "0x1f": None, "-.5": -0.5, "1e999": None, None: None}
    got = spark.createDataFrame([(x,) for x in cases], "x string").select("x", validation.number(F.col("x")).alias("n"), validation.number_for_field(F.col("x")).alias("f")).collect()
    assert {r.x: r.n for r in got} == cases and {r.x: r.f for r in got}["1,5"] == "15"
    fields = spark.createDataFrame([("NT$ 1,200 元",), ("about",), ("1 2-3",)], "x string").select(validation.number_for_field(F.col("x")).alias("f")).collect()
    assert [r.f for r in fields] == ["1200", None, None]


def test_changes_and_views_of_groups(spark):
    schema = "item long, group_id string, keeper long, level string"
    old = spark.createDataFrame([(1, "a", 1, "same"), (2, "a", 1, "same"), (3, "a", 1, "similar"), (4, "b", 4, "same"), (9, "z", 9, "same")], schema)
    new = spark.createDataFrame([(1, "a", 1, "same"), (2, "c", 2, "same"), (3, "a", 1, "same"), (5, "c", 2, None), (6, "c", 2, "same")], schema)
    scope = spark.createDataFrame([(1, True), (2, True), (3, False), (4, False), (5, True), (6, None)], "item long, fresh boolean")
    assert sorted((r.item, r.change) for r in groups.changes(old, new, scope).collect()) == [(2, "changed"), (3, "stale"), (4, "removed"), (5, "added"), (6, "stale")]
    assert groups.changes(old.limit(0), new.limit(0), scope).count() == 0
    assert sorted(r.group_id for r in groups.new_groups(new, old).collect()) == ["c"]
    times = [(i, f"n{i}", i * 10, START + timedelta(seconds=i), i != 6) for i in range(1, 10)]
    items = spark.createDataFrame(times, "item long, name string, bytes long, mtime timestamp, live boolean")
    view = {(r.group_id, r.page): r for r in groups.nested(new, items, F.col("live"), 1).collect()}
    assert set(view) == {("a", 0), ("c", 0)}  # one other live member each
    assert [m.item for m in view["a", 0].members] == [3] and view["c", 0].n == 1 and view["c", 0].span_seconds == 3 and view["c", 0].level == "same"
    assert groups.nested(new, items.where("item <> 1"), F.col("live")).where("group_id = 'a'").count() == 0


def test_health_of_an_empty_and_a_mixed_quarantine(spark):
    journal = spark.createDataFrame([(1, 1, 1, "quarantine", "done"), (2, 1, 2, "quarantine", "done"), (3, 1, 2, "restore", "started"), (4, 1, 3, "quarantine", "done"), (5, 1, 3, "restore", "done"), (6, 1, 4, "quarantine", "failed")], "seq long, plan_id long, item_id long, op string, status string")
    details = spark.createDataFrame([(n, START + timedelta(days=n), 10 * n, START) for n in range(1, 7)], "seq long, completed_at timestamp, bytes long, mtime timestamp")
    purges = spark.createDataFrame([(9, "done"), (1, "started")], "seq long, status string")
    row = health.can_empty(health.quarantine(journal, details, purges, 5, 1), F.lit("2024-01-09").cast("timestamp")).first()
    assert (row["items"], row.bytes, row.orphans, row.truncated, row.can_empty_now) == (2, 30, 2, False, True)
    none = health.can_empty(health.quarantine(journal.limit(0), details, purges, -1), F.lit("2024-01-09").cast("timestamp")).first()
    assert (none["items"], none.bytes, none.orphans, none.truncated, none.can_empty_now) == (0, 0, 0, True, False)
    fields = "healthy boolean, has_error boolean, roots_missing int, problems int, proposed_plans int, ready int, watching boolean"
    rows = [(True, False, 0, 0, 1, 5, True), (True, None, None, None, None, 5, True), (True, False, 0, 0, 0, 0, True), (True, False, 0, 0, 0, 0, None), (True, False, 1, 0, 1, 1, True), (None, False, 0, 0, 0, 0, True)]
    assert [r.state for r in health.state(spark.createDataFrame(rows, fields)).collect()] == ["waiting", "found", "watching", "idle", "worried", "worried"]
    counted, seen = health.counted(journal, "pass", rows=F.count("*"), failed=F.count_if(F.col("status") == "failed"))
    assert counted.where("op = 'restore'").count() == 2 and seen.get == {"rows": 6, "failed": 1}


# --- fields, free names, old proposals ---


def test_fields_by_labels_and_tokens(spark):
    registry = spark.createDataFrame([("name", 0, ["Name", "full name"], "name", "normal"), ("phone", 1, ["phone", "tel"], "tel", "normal"), ("id", 2, ["ID", "id number"], None, "sensitive"), ("pin", 3, ["pin code"], "pin", "secret"), ("x", 4, ["x"], None, "normal")], "key string, ord int, aliases array<string>, autocomplete string, sensitivity string")
    rows = [
        (1, ["", "Ｆｕｌｌ Name*"], "tel", False), (2, ["Your phone"], None, None), (3, None, "section name tel", False), (4, ["nothing"], "other", False), (5, ["ID number"], None, True),
        (6, ["ID number and phone"], None, False), (7, ["ID number (phone)"], None, False), (8, ["ID number"], "name", False), (9, ["x"], None, False), (10, ["xy"], None, False), (11, [None, "tel"], "tel", False), (12, [], "", False),
    ]
    got = {r.field: tuple(r)[1:] for r in lookups.match_fields(spark.createDataFrame([(*r, "k") for r in rows], "field long, labels array<string>, autocomplete string, masked boolean, key string"), registry).collect()}
    assert got[1] == ("name", 2, "Ｆｕｌｌ Name*", "phone", True, None) and got[2][:2] == ("phone", 2) and got[3] == ("phone", 1, "section name tel", None, False, None)
    assert got[4] == got[12] == (None, 0, None, None, False, None) and got[5][0] is None and got[5][-1] == "hidden words" and got[6][-1] == "also like phone"
    assert got[7][0] == "id" and got[8][-1] == "autocomplete says name" and got[9][0] == "x" and got[10][1] == 0 and got[11][:2] == ("phone", 2)
    assert len(got) == len(rows) and lookups.match_fields(spark.createDataFrame([], "field long, labels array<string>, autocomplete string, masked boolean"), registry).count() == 0


def test_restored_files_get_the_first_free_names(spark):
    rng = random.Random(3)
    taken = {f"/a{s}" for s in ["", ".restored", ".restored.3", ".restored.1", ".restored.x", ".restored.04"]} | {f"/b{'.restored' if n == 1 else f'.restored.{n}' if n else ''}" for n in range(12)} | {"/c.restored"}
    moves = [(n, rng.choice(["/a", "/b", "/c", "/d"])) for n in range(60)]
    frame = spark.createDataFrame([(*m, "t") for m in moves], "id long, path string, target string")
    got = {r.id: r.target for r in lookups.free_targets(frame, spark.createDataFrame([(p,) for p in taken] * 2, "path string"), 16).collect()}
    for n, path in sorted(moves):
        options = [path, f"{path}.restored", *(f"{path}.restored.{k}" for k in range(2, 17))]
        free = next((o for o in options if o not in taken), None)
        assert got[n] == free
        taken.add(free)
    assert None in got.values() and lookups.free_targets(frame.limit(0), frame.select("path")).count() == 0


def test_old_proposals_that_never_began(spark):
    plans = spark.createDataFrame([(1, "proposed", START), (2, "proposed", None), (3, "applied", START), (4, "proposed", START), (5, "proposed", START + timedelta(days=9)), (6, "proposed", START)], "plan long, status string, created_at timestamp")
    got = lookups.stale_proposals(plans, spark.createDataFrame([(4,), (4,)], "plan long"), F.lit("2024-01-05").cast("timestamp"), 6)
    assert [r.plan for r in got.collect()] == [1]


# --- filing ---


def test_offers_follow_what_is_taught_and_what_is_there(spark):
    opinions = [(1, "a", "OS", "Exam", "x"), (2, "a", " ＯＳ ", "what", None), (3, "b", "OS", "Exam", "x"), (4, "a", "", "Exam", "My  Phrase"), (5, "a", None, None, None), (6, "a", "Math", "Exam", "x"), (7, None, "OS", "Exam", "x")]
    store = [("a", "course", "os", "Operating Systems"), ("a", "file_kind", "os\nOther", "Lecture"), ("a", "rejected", "1\nCourses/operating systems/Exam", ""), ("a", "course", "math", "MATH"), ("b", "course", "os", "  ")]
    frame = spark.createDataFrame([(*o, "clash") for o in opinions], "item long, owner string, course string, kind string, phrase string, folder string")
    kept = spark.createDataFrame(store, "owner string, kind string, k string, v string")
    folders = spark.createDataFrame([("os",), ("OS",), ("operating systems",)], "name string")
    mapped = spark.createDataFrame([("my phrase", "Mine")], "phrase string, folder string")
    got = {r["item"]: r for r in filing.offered(frame, kept, folders, mapped, ["Exam", "Lecture"]).collect()}
    assert (got[1].folder, got[1].also_known_as, got[1].was_rejected, got[1].learned_course) == ("Courses/operating systems/Exam", "OS", True, True)
    assert (got[2].folder, got[2].learned_kind, got[2].was_rejected) == ("Courses/operating systems/Lecture", True, False)
    assert got[3].folder == got[7].folder == "Courses/OS/Exam" and not got[3].learned_course
    assert (got[4].folder, got[4].course) == ("Mine", "") and got[5].folder is None and got[6].folder == "Courses/Math/Exam"
    assert filing.offered(frame.limit(0), kept, folders, mapped, []).count() == 0
    typed = [("OS", "OS_ch1.pdf", "BS_ch1.pdf", "BS"), ("OS", "OS_ch1.pdf", "ＯＳ_ch1.pdf", None), ("OS", "OS_ch1.pdf", "OS_ch2.pdf", None), ("OS", "OS", "BS", None), ("OS", "OS_a", "_a", None), (None, "x", "y", None)]
    rows = spark.createDataFrame(typed, "c string, n string, a string, want string").select("want", filing.taught_course(F.col("c"), F.col("n"), F.col("a")).alias("got")).collect()
    assert all(r.got == r.want for r in rows)


def test_copies_of_a_file_with_a_view_are_filable(spark):
    items = spark.createDataFrame([(1, "s", "kept", None), (2, "s", "candidate", None), (3, None, "kept", None), (4, "t", "kept", None), (5, "s", "missing", None), (6, "s", "kept", "bad")], "id long, sha256 string, status string, error string")
    got = filing.filable(items, spark.createDataFrame([(1,), (1,), (3,)], "item long"))
    assert sorted(r.id for r in got.collect()) == [1, 2, 3] and got.columns == items.columns
