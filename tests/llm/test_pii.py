import hashlib
import random
import re

from filewright.llm import pii, queries

SHAPES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    return sum((d := int(c) * (1 + i % 2)) - 9 * (d > 9) for i, c in enumerate(reversed(digits))) % 10 == 0


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def brute(text):
    found = [(m.start(), n, kind, m.end()) for n, (kind, shape) in enumerate(SHAPES) for m in re.finditer(shape, text) if passes(kind, m.group(0))]
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in sorted(found)), [sum(f[2] == kind for f in found) for kind, _ in SHAPES]


def texts():
    rng = random.Random(4)
    bits = ["a.b@c.d", "x@y", "@", ".", "-", "+1", " ", "4111 1111 1111 1111", "5500-0000-0000-0004", "10.0.0.1", "256.1.1.1", "007.0255.1.1", "1.2.3.4.5", "(555) 123-4567", "12", "_", "%", "é", "\U0001f600", "\x01", "\x02", "\n", "z@z.zz-"]
    out = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    return [*out, None, "", "a" * 8_000, "1" * 8_000, "1 " * 5_000 + "x@y.z", "a@b.c_d@e.f", "+1 (988) 555-2485 4041894974608795"]


def test_base_spans_match_brute_force(spark, tmp_path):
    rows = [(n, x, "kind") for n, x in enumerate(texts())] + [(None, "a@b.cd", "k"), (1, "10.0.0.1", "k")]
    spark.createDataFrame(rows, "doc_id long, text string, kind string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in queries.op6_pii(spark, str(tmp_path)).collect())
    want = sorted((str(i), *brute(x or "")[1], hashlib.sha256(brute(x or "")[0].encode()).hexdigest()) for i, x, _ in rows)
    assert got == want


def test_contexts_discover_unseen_identifiers_and_leave_others_alone(spark):
    docs = [(i, f"report {i}\nplease write to mail address: user{i}@host{i}.example.com today. Version 4.{i}.") for i in range(40)]
    docs += [(100, "please write to mail address: jane[at]host77 today"), (101, "mail for jane7[at]host.example again"), (102, "the code jane7[at]host.example came"), (103, "please write to mail address: jane7_at_host.example today"), (104, "elsewhere jane7_at_host.example stands alone"), (105, "order 12345678 and release 7.8.9-rc1 are fine"), (106, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.base_spans, r.spans) for r in pii.report(frame).collect()}
    value = "jane7_at_host.example"
    for i in (103, 104):
        text = dict(docs)[i]
        assert got[i] == ("", f"email:{text.index(value)}:{text.index(value) + len(value)}")
    assert got[105] == ("", "") and got[106] == ("", "")
    assert all(got[i][0] == got[i][1] == brute(docs[i][1])[0] for i in range(40))
    clean = {r.doc_id: r.text for r in pii.redact(frame).collect()}
    assert clean[103] == "please write to mail address: <EMAIL> today" and clean[105] == dict(docs)[105] and clean[106] is None
    assert "@" not in clean[5] and clean[5].endswith("today. Version 4.5.")
    assert pii.report(frame.limit(0)).count() == 0


def test_plans_hold_no_python(spark):
    frame = spark.createDataFrame([(1, "a@b.cd")], "doc_id long, text string")
    for made in (pii.report(frame), pii.redact(frame)):
        plan = made._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_redaction_holds_when_a_second_read_deals_the_rows_otherwise(spark, tmp_path, monkeypatch):
    rows = [(n, f"{'x' * n} user{n}@host.example") for n in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(6).write.parquet(str(tmp_path / "docs"))
    real = pii.stash

    def moving(df, label):  # the files are split otherwise from then on
        done = real(df, label)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
        return done

    monkeypatch.setattr(pii, "stash", moving)
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        got = sorted(tuple(r) for r in pii.redact(spark.read.parquet(str(tmp_path / "docs"))).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == [(n, f"{'x' * n} <EMAIL>") for n in range(60)]


def test_chains_of_three_steps_are_followed_to_the_end(spark):
    contexts, name = ("alpha beta gamma", "delta epsilon zeta", "eta theta iota"), lambda i: f"name{i}_at_host.example"
    texts = [f"{contexts[0]} user{i}@host{i}.example.com" for i in range(100)]
    texts += [f"{contexts[0]} {name(i)}" for i in range(20)] + [f"{contexts[1]} {name(i)}" for i in range(25)] + [f"{contexts[2]} {name(i)}" for i in range(20, 26)]
    found = pii.occurrences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(tuple(r) for r in pii.discover(pii.stash(found, "chain")).collect()) == sorted((name(i), "email") for i in range(26))


def test_many_matches_in_one_document_take_linear_time(spark):
    text = "é " + " ".join(f"user{n}@host.example" for n in range(100_000))
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = pii.redact(frame).collect()[0].text
    assert got == "é " + " ".join(["<EMAIL>"] * 100_000)
    assert pii.report(frame).collect()[0].n_email == 100_000


def test_columns_of_any_name_come_back_as_they_are(spark):
    row = (1, "a@b.cd", "x", 2, [1], "k")
    docs = spark.createDataFrame([row], "doc_id long, text string, uid string, n long, spans array<int>, `kind.x` string")
    assert [tuple(r) for r in pii.redact(docs).collect()] == [(1, "<EMAIL>", *row[2:])]


def test_numbers_in_groups_and_addresses_without_digits_are_discovered(spark):
    texts = [f"call the desk phone at +1 (555) {200 + i}-{1000 + i} now" for i in range(30)] + [f"his mail address is user{i}@host.example ok" for i in range(30)]
    texts += ["call the desk phone at 555 123 4567 now", "call the desk phone at (555) 987-6543 now", "his mail address is jane_at_host.example ok", "in the years 2019 2020 we grew"]
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[60] == "phone:23:35" and got[61] == "phone:23:37" and got[62] == "email:20:40" and got[63] == ""


def test_long_runs_without_a_match(spark):
    rows = [(1, "a" * 200_000), (2, "1" * 100_000), (3, "1 " * 50_000 + "x@y.z")]
    got = {r.doc_id: r.base_spans for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "", 2: "", 3: "email:100000:100005"}
