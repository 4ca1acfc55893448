import io
import json
import zipfile

from pyspark.sql import functions as F

from filewright.plans import think
from filewright.sources import texts

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006"'


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


DOCX = zipped({"word/document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>Hello</w:t><w:tab/><w:t>there</w:t></w:r><w:del><w:r><w:t>gone</w:t></w:r></w:del><w:r><w:rPr><w:vanish/></w:rPr><w:t>unseen</w:t></w:r></w:p><w:p><w:r><w:t>two</w:t><w:noBreakHyphen/><w:t>x</w:t></w:r></w:p></w:body></w:document>"})
SLIDE = '<p:sld xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><a:p><a:r><a:t>{}</a:t></a:r></a:p></p:sld>'
PPTX = zipped(
    {
        "ppt/presentation.xml": '<p:presentation xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><p:sldIdLst><p:sldId id="1" r:id="b"/><p:sldId id="2" r:id="a"/><p:sldId id="3" r:id="b"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": '<Relationships><Relationship Id="a" Target="slides/s1.xml"/><Relationship Id="b" Target="/ppt/slides/s2.xml"/></Relationships>',
        "ppt/slides/s1.xml": SLIDE.format("first file"),
        "ppt/slides/s2.xml": SLIDE.format("second file"),
    }
)


def test_readers_encodings_and_reasons(spark):
    files = {
        "a.txt": ("plain é".encode(), "plain é", None), "b.txt": (b"\xff\xfe" + "wide".encode("utf-16-le"), "wide", None), "c.txt": ("中文字".encode("big5"), "中文字", None), "d.csv": (b"caf\xe9!", "café!", None),
        "e.docx": (DOCX, "Hello\tthere\ntwo-x", None), "f.pptx": (PPTX, "second file\n\nfirst file", None), "g.docx": (b"no zip", None, "BadZipFile"), "h.docx": (zipped({"x": "y"}), None, "KeyError"), "i.md": (b"", "", None), "k.txt": (b"x" * 5000, "x" * 4000, None),
    }
    frame = spark.createDataFrame([(n, "." + n.split(".")[1], b[0]) for n, b in files.items()] + [("z.mp3", ".mp3", b"?")], "path string, ext string, content binary")
    got = {r.path: r for r in texts.read_texts(frame).collect()}
    assert set(got) == set(files)
    for name, (_, text, why) in files.items():
        assert got[name].text == text and (got[name].reason or "").startswith(why or "") and bool(got[name].reason) == bool(why)
    assert got["k.txt"].truncated and got["k.txt"].chars == 5000 and not got["i.md"].has_text


def view(**changes):
    return json.dumps({f: "x" for f in think.FIELDS} | {"confidence": "high"} | changes)


def test_views_parse_strictly(spark):
    cases = [(view(), True), (view(confidence="sure"), False), (view(extra="y"), False), (view(topic=5), False), (view(topic=None), False), (view().replace('"x"', '"x\n"', 1), True), ("not json", False), (None, False), (json.dumps({"course": "x"}), False)]
    frame = spark.createDataFrame([(n, c) for n, (c, _) in enumerate(cases)], "n int, raw string")
    got = {r.n: r.v is not None for r in frame.select("n", think.parse_view(F.col("raw")).alias("v")).collect()}
    assert got == {n: ok for n, (_, ok) in enumerate(cases)}


def test_a_round_asks_once_and_links_twins(spark, tmp_path):
    long = "a lecture about something long enough to be asked about"
    rows = [("1", "a.txt", long), ("2", "b.txt", long), ("3", "password.txt", long + "!"), ("4", "c.txt", "short"), ("5", "d.txt", "cached text that is long enough as well, yes"), ("6", "e.txt", "bad answer for a text that is long enough to ask")]
    items = spark.createDataFrame(rows, "item_id string, name string, text string")
    old = think.payloads(items.where("item_id = '5'"), "v1").select("key", think.parse_view(F.lit(view(topic="old"))).alias("view"))
    log = str(tmp_path / "asked")

    def ask(payload):
        with open(log, "a") as file:
            file.write(payload[:10] + "\n")
        return "nonsense" if payload.startswith("bad") else view(topic="new")

    held, links = think.think_round(items, old, ask, "v1")
    assert sorted(r.item_id for r in links.collect()) == ["1", "2", "5"]
    assert sorted(open(log).read().split("\n")) == ["", "a lecture ", "bad answer"]
    assert sorted(r.view.topic for r in held.collect()) == ["new", "old"]


def test_form_actions(spark):
    keys = spark.createDataFrame([(k,) for k in ("name", "id", "full", "job", "phone", "what")], "key string")
    registry = spark.createDataFrame([("name", None, "low"), ("id", None, "high"), ("full", "compose", "low"), ("job", None, "low"), ("phone", None, "low")], "key string, fill string, sensitivity string")
    facts = spark.createDataFrame([("name", "Lee", "confirmed"), ("id", "A1", "confirmed"), ("job", "x", "confirmed"), ("job", "y", "confirmed"), ("phone", "1", "stale")], "key string, value string, status string")
    assert {r.key: (r.action, r.value) for r in think.for_form(keys, registry, facts).collect()} == {"name": ("fill", "Lee"), "id": ("confirm-each-time", "A1"), "full": ("compose", None), "job": ("pick", None), "phone": ("missing", None), "what": ("unknown", None)}
