import random

import pytest
from pyspark.sql import functions as F

from filewright.functions import names
from filewright.operators import rules
from filewright.sources import forms


@pytest.mark.parametrize(("name", "ext", "want"), [(" a/b: report.pdf. ", ".pdf", "ab report"), ("x.pdf.pdf", ".pdf", "x"), ("CON", ".txt", ""), ("con.notes", None, ""), ("é", None, "é"), (None, None, ""), ("...", None, ""), ("a‮b", None, "ab")])
def test_clean_names(name, ext, want):
    assert names.clean(name, ext) == want


def test_cleaning_properties():
    rng = random.Random(7)
    for _ in range(2000):
        text = "".join(rng.choice("ab .\\/:*?\"<>|\x00‮éáｆ漢😀.pdf") for _ in range(rng.randint(0, 120)))
        got = names.clean(text, ".pdf")
        assert names.clean(got, ".pdf") == got and len(got) <= 80 and len((got + ".pdf").encode()) <= 250
        assert not set(got) & set('\\/:*?"<>|\x00‮') and got == got.strip(" .")


def test_free_names_and_targets(spark):
    rows = spark.createDataFrame([("a", ".txt", ["a.txt", "a-2.txt"], "p", ["p", "p.restored"]), ("B", "", [], "p", [])], "s string, e string, t array<string>, p string, q array<string>")
    got = rows.select(names.free_name(F.col("s"), F.col("e"), F.col("t")).alias("f"), names.restore_target(F.col("p"), F.col("q")).alias("r"), names.strip_unknown(F.lit("Unknown_未知_HW1.pdf")).alias("u"), names.clean_name(F.lit("x?.md"), F.lit(".md")).alias("c")).collect()
    assert [tuple(r) for r in got] == [("a-3.txt", "p.restored.2", "HW1.pdf", "x"), ("B", "p", "HW1.pdf", "x")]


def test_options(spark):
    cases = [
        ("tp", [("tp", "Taipei", False), ("x", "tp", False)], "tp"),  # an equal value wins
        ("Taipei", [("1", " Taipei ", False), ("2", "Taipei City", False)], "1"),
        ("MALE", [("male", "x", False), ("female", "y", False)], "male"),
        ("男", [("", "請選擇", False), ("m", "男性", False), ("f", "女性", False)], "m"),
        ("Tai", [("1", "Taipei", False), ("2", "Taichung", False)], None),  # several contain it
        ("役畢", [("1", "替代役", False)], None),
        ("male", [("male", "x", True)], "male"),  # disabled, but equal
        ("Male", [("male", "x", True)], None),
        (None, [("1", "a", False)], None),
    ]
    rows = spark.createDataFrame([(n, w, o) for n, (w, o, _) in enumerate(cases)], "n int, w string, o array<struct<value:string,text:string,disabled:boolean>>")
    got = [r.v for r in rows.select("n", names.pick_option(F.col("o"), F.col("w"))["value"].alias("v")).orderBy("n").collect()]
    assert got == [want for *_, want in cases]


def test_refused_names_are_those_of_the_list(spark):
    refused = ["token", "Secrets", ".x", "id_ecdsa", "ID_RSA.bak", "data.db.x", "a.PEM", "keychain"]
    admitted = ["token.txt", "credentials.md", "data.dbx", "known_hosts", "notes.txt"]
    rows = spark.createDataFrame([(n,) for n in [*refused, *admitted]], "name string")
    assert {r.name for r in rows.where(rules.refuses_name(F.col("name"))).collect()} == set(refused)


def test_form_fields_with_their_labels(spark):
    html = '<form><label for="e">E-mail <b>address</b></label><input id=e name=email autocomplete=email><label>Phone <input type=tel placeholder="09..."></label><input type=hidden name=h><select name=city><option>x</select><textarea aria-label="Why"></textarea><label>open'
    got = forms.fields(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")).orderBy("ord").collect()
    assert [(r.page_id, r.ord, r.name, r.type, r.autocomplete, r.labels) for r in got] == [(1, 0, "email", "input", "email", ["E-mail address", "email"]), (1, 1, None, "tel", None, ["Phone", "09..."]), (1, 2, "city", "select", None, ["city"]), (1, 3, None, "textarea", None, ["Why"])]
