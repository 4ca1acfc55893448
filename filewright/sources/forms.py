"""Form fields of web pages with the texts that label them, as a table function over pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

CONTROLS = frozenset(("input", "select", "textarea"))
UNFILLABLE = frozenset(("hidden", "submit", "button", "reset", "image", "file"))
VOID = frozenset(("input", "br", "hr", "img", "meta", "link"))
FIELDS = "page_id {}, ord int, name string, type string, autocomplete string, labels array<string>"


class Fields(HTMLParser):
    """Collects controls; a label is one that names the id, one around it, or its own attributes."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.fields: list[dict] = []
        self.by_id: dict[str, list[str]] = {}
        self.open: list[dict] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "label":
            self.open.append({"for": a.get("for"), "text": [], "fields": []})
        if tag in CONTROLS and a.get("type", "").lower() not in UNFILLABLE:
            field = {"id": a.get("id"), "name": a.get("name") or None, "type": a.get("type", tag).lower(), "autocomplete": a.get("autocomplete") or None, "own": [a[k] for k in ("aria-label", "placeholder", "title") if a.get(k)], "around": []}
            self.fields.append(field)
            if self.open:
                self.open[-1]["fields"].append(field)

    def handle_data(self, data: str) -> None:
        if self.open:
            self.open[-1]["text"].append(data)

    def handle_endtag(self, tag: str) -> None:
        if tag == "label" and self.open:
            self._close()

    def _close(self) -> None:
        label = self.open.pop()
        text = " ".join("".join(label["text"]).split())
        if text and label["for"]:
            self.by_id.setdefault(label["for"], []).append(text)
        for field in label["fields"]:
            if text:
                field["around"].append(text)

    def rows(self) -> list[tuple]:
        while self.open:
            self._close()
        return [(n, f["name"], f["type"], f["autocomplete"], list(dict.fromkeys([*self.by_id.get(f["id"] or "", []), *f["around"], *f["own"], *([f["name"]] if f["name"] else [])]))) for n, f in enumerate(self.fields)]


def fields(pages: DataFrame) -> DataFrame:
    """``(page_id, ord, name, type, autocomplete, labels)`` of every fillable control of ``pages(page_id, html)``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for page, html in zip(frame["page_id"], frame["html"], strict=True):
                parser = Fields()
                parser.feed(html or "")
                parser.close()
                out += [(page, *row) for row in parser.rows()]
            yield pd.DataFrame(out, columns=["page_id", "ord", "name", "type", "autocomplete", "labels"]).astype({"ord": "int32"})

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "html").mapInPandas(run, FIELDS.format(kind))
