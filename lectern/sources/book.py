"""Books: reading and writing EPUB files, units of XHTML, tagging units."""

from __future__ import annotations

import hashlib
import html
import io
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Elements that end a unit, and those without content.
BLOCKS = frozenset((
    "address", "article", "aside", "footer", "header", "h1", "h2", "h3", "h4", "h5", "h6", "hgroup", "main", "nav", "section", "search",
    "blockquote", "dd", "div", "dl", "dt", "figcaption", "figure", "hr", "li", "menu", "ol", "p", "pre", "ul",
    "table", "thead", "th", "tbody", "tr", "td", "colgroup", "caption", "tfoot",
))
#: Elements that end a unit too, as nothing runs through them.
FRAMES = frozenset(("html", "body"))
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset(("script", "style", "head", "title"))
CHAPTER = "path string, chapter_id string, href string, spine_idx int, name string, media_type string, properties array<string>, xml string, text string, has_script boolean"
BOOK = "path string, version string, title string, creator string, language string, identifier string, date string, publisher string, subject string, error string"

_end = re.compile(r"(?<=[.!?])\s+")


class Units(HTMLParser):
    """Collects inline text and cuts it into sentences at block boundaries; with `tag`, writes the document again with a span around each."""

    def __init__(self, tag: str | None = None):
        super().__init__(convert_charrefs=False)
        self.tag, self.units, self.out, self.run, self.hidden, self.script = tag, [], [], [], 0, False

    def _flush(self) -> None:
        text = "".join(t for kind, t, _ in self.run if kind == "text")
        cuts = [0]
        for m in _end.finditer(text):
            if any(c.isalnum() for c in text[cuts[-1] : m.end()]) and any(c.isalnum() for c in text[m.end() :]):
                cuts.append(m.end())
        cuts.append(len(text))
        spoken = any(c.isalnum() for c in text) or bool(text.strip())
        first = len(self.units)
        if spoken:
            self.units += [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        at = 0
        for kind, t, raw in self.run:
            if kind != "text":
                self.out.append(raw)
                continue
            if not spoken or not self.tag:
                self.out.append(raw)
            else:
                for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    lo, hi = max(a, at), min(b, at + len(t))
                    if lo < hi:
                        part = html.escape(t[lo - at : hi - at], quote=False)
                        self.out.append(f'<span id="{self.tag}-sentence{first + i}">{part}</span>' if part.strip() and lo == a else f'<span data-sentence="{self.tag}-sentence{first + i}">{part}</span>' if part.strip() else part)
            at += len(t)
        self.run = []

    def _mark(self, tag: str, raw: str, inline: bool) -> None:
        if inline:
            self.run.append(("tag", "", raw))
        else:
            self._flush()
            self.out.append(raw)

    def handle_starttag(self, tag, attrs):
        self.script |= tag == "script"
        self._mark(tag, self.get_starttag_text(), tag not in BLOCKS | FRAMES | HIDDEN)
        self.hidden += tag in HIDDEN

    def handle_startendtag(self, tag, attrs):
        self._mark(tag, self.get_starttag_text(), tag not in BLOCKS)

    def handle_endtag(self, tag):
        self.hidden = max(0, self.hidden - (tag in HIDDEN))
        if tag not in VOID:
            self._mark(tag, f"</{tag}>", tag not in BLOCKS | FRAMES | HIDDEN)

    def handle_data(self, data):
        self._text(data, data)

    def handle_entityref(self, name):
        self._text(html.unescape(f"&{name};"), f"&{name};")

    def handle_charref(self, name):
        self._text(html.unescape(f"&#{name};"), f"&#{name};")

    def _text(self, text: str, raw: str) -> None:
        if self.hidden:
            self.out.append(raw)
        else:
            self.run.append(("text", text, raw))

    def handle_decl(self, decl):
        self._mark("", f"<!{decl}>", False)

    def handle_pi(self, data):
        self._mark("", f"<?{data}>", False)

    def handle_comment(self, data):
        self._mark("", f"<!--{data}-->", True)

    def close(self):
        super().close()
        self._flush()


def units_of(xml: str | None) -> list[str]:
    p = Units()
    p.feed(xml or "")
    p.close()
    return [u.strip() for u in p.units if u.strip()]


def tag_units(xml: str | None, chapter_id: str) -> tuple[str, int]:
    """The document with each unit in a span whose id, used once, is chapter_id-sentenceN; where inline markup splits a unit, further spans refer to it."""
    p = Units(str(chapter_id))
    p.feed(xml or "")
    p.close()
    return "".join(p.out), len(p.units)


def page_units(pages: DataFrame) -> DataFrame:
    """(page_id, unit_id, text) of each page's html."""

    @F.pandas_udf("array<string>")
    def split(xml: pd.Series) -> pd.Series:
        return xml.map(units_of)

    return pages.select("page_id", F.posexplode(split("html")).alias("unit_id", "text"))


def tagged(chapters: DataFrame) -> DataFrame:
    """(chapter_id, xml, n_units) with units tagged; chapters are independent."""

    @F.pandas_udf("xml string, n_units int")
    def run(xml: pd.Series, chapter: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([tag_units(x, c) for x, c in zip(xml, chapter, strict=True)], columns=["xml", "n_units"])

    return chapters.select("chapter_id", run("xml", F.col("chapter_id").cast("string")).alias("t")).select("chapter_id", "t.*")


def local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def parse_epub(path: str, data: bytes) -> tuple[dict, list[dict]]:
    """A book's row and its chapters in spine order. Version 2 books and books with overlays already are refused, by an error in the row."""
    row: dict = dict.fromkeys(("version", "title", "creator", "language", "identifier", "date", "publisher", "subject", "error"))
    row["path"] = path
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
        roots = [e.get("full-path") for e in ET.fromstring(z.read("META-INF/container.xml")).iter() if local(e) == "rootfile" and e.get("full-path")]
        if not roots:
            raise ValueError("no package document")
        opf = roots[-1]
        package = ET.fromstring(z.read(opf))
        row["version"] = package.get("version")
        for e in package.iter():
            if local(e) in row and e.tag.startswith("{http://purl.org/dc/"):
                row[local(e)] = (e.text or "").strip()
        if row["version"] == "2.0":
            raise ValueError("EPUB 2 is not supported")
        items = {e.get("id"): e for e in package.iter() if local(e) == "item" and e.get("id") and e.get("href")}
        if any(e.get("media-overlay") for e in items.values()):
            raise ValueError("already aligned")
        base = posixpath.dirname(opf)
        at = lambda href: posixpath.normpath(posixpath.join(base, href))
        toc: dict[str, str] = {}
        for e in items.values():
            if "nav" in (e.get("properties") or "").split():
                nav = at(e.get("href"))
                for a in ET.fromstring(z.read(nav)).iter():
                    name = " ".join("".join(a.itertext()).split())
                    if local(a) == "a" and a.get("href") and name:
                        toc[posixpath.normpath(posixpath.join(posixpath.dirname(nav), a.get("href").partition("#")[0]))] = name
        chapters = []
        refs = [e.get("idref") for e in package.iter() if local(e) == "itemref" and e.get("idref")]
        for i, ref in enumerate(refs):
            if ref not in items:
                raise ValueError(f"spine item {ref} is not in the manifest")
            e = items[ref]
            href = at(e.get("href"))
            xml = z.read(href).decode("utf-8", "replace")
            p = Units()
            p.feed(xml)
            p.close()
            chapters.append({"path": path, "chapter_id": ref, "href": href, "spine_idx": i, "name": (toc.get(href) or ref)[:32], "media_type": e.get("media-type"), "properties": (e.get("properties") or "").split(), "xml": xml, "text": "\n".join(u.strip() for u in p.units), "has_script": p.script})
        return row, chapters
    except (ValueError, KeyError, ET.ParseError, zipfile.BadZipFile) as e:
        return {**row, "error": str(e)}, []


def _books(spark: SparkSession, path: str, schema: str, rows) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(frames):
        for f in frames:
            found = [r for p, d in zip(f["path"], f["content"], strict=True) for r in rows(*parse_epub(p, bytes(d)))]
            yield pd.DataFrame(found, columns=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def parts_of(path: str, data: bytes) -> dict[str, list[tuple]]:
    """The tables of a book's package: manifest items, guide references, and the nav's landmarks and toc; empty where the file is no book.

    Items need an id and an href, references a type and an href; of the landmarks those to the body and the back matter count; toc entries need a name.
    """
    out: dict[str, list[tuple]] = {"manifest": [], "guide": [], "landmarks": [], "toc": []}
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
        opf = [e.get("full-path") for e in ET.fromstring(z.read("META-INF/container.xml")).iter() if local(e) == "rootfile" and e.get("full-path")][-1]
        package = ET.fromstring(z.read(opf))
        at = lambda base, href: posixpath.normpath(posixpath.join(posixpath.dirname(base), href))
        nav = None
        for e in package.iter():
            if local(e) == "item" and e.get("id") and e.get("href"):
                properties = (e.get("properties") or "").split()
                out["manifest"].append((path, len(out["manifest"]), e.get("id"), at(opf, e.get("href")), e.get("media-type"), properties, e.get("media-overlay")))
                nav = at(opf, e.get("href")) if "nav" in properties and nav is None else nav
            elif local(e) == "reference" and e.get("type") and e.get("href"):
                out["guide"].append((path, len(out["guide"]), e.get("type"), at(opf, e.get("href")), e.get("title")))
        for e in ET.fromstring(z.read(nav)).iter() if nav else ():
            kind = (e.get("{http://www.idpf.org/2007/ops}type") or "").split()[:1] if local(e) == "nav" else []
            for a in e.iter() if kind in (["landmarks"], ["toc"]) or local(e) == "nav" and not kind else ():
                if local(a) != "a" or not a.get("href"):
                    continue
                name, place = " ".join("".join(a.itertext()).split()), (a.get("{http://www.idpf.org/2007/ops}type") or "").split()[:1]
                if kind == ["landmarks"] and place in (["bodymatter"], ["backmatter"]):
                    out["landmarks"].append((path, len(out["landmarks"]), place[0], at(nav, a.get("href"))))
                elif kind != ["landmarks"] and name:
                    out["toc"].append((path, len(out["toc"]), at(nav, a.get("href")), name))
    except (KeyError, IndexError, ET.ParseError, zipfile.BadZipFile):
        return {k: [] for k in out}
    return out


#: Columns of the tables that parts_of() gives.
PARTS = {
    "manifest": "path string, idx int, id string, href string, media_type string, properties array<string>, media_overlay string",
    "guide": "path string, idx int, kind string, href string, title string",
    "landmarks": "path string, idx int, kind string, href string",
    "toc": "path string, idx int, href string, title string",
}


def read_parts(spark: SparkSession, path: str, table: str) -> DataFrame:
    """One of the tables in PARTS, of all books."""
    names = [x.split()[0] for x in PARTS[table].split(", ")]

    def run(frames):
        for f in frames:
            yield pd.DataFrame([r for p, d in zip(f["path"], f["content"], strict=True) for r in parts_of(p, bytes(d))[table]], columns=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, PARTS[table])


def spine_overlays(manifest: DataFrame, spine: DataFrame) -> DataFrame:
    """(path, spine_idx, chapter href, smil href): the overlay of each spine item (path, spine_idx, chapter_id) that has one of the right type."""
    items = manifest.select("path", F.col("id").alias("chapter_id"), F.col("href").alias("chapter_href"), "media_overlay")
    smil = manifest.filter("media_type = 'application/smil+xml'").select("path", F.col("id").alias("media_overlay"), F.col("href").alias("smil"))
    return spine.select("path", "spine_idx", "chapter_id").join(items, ["path", "chapter_id"]).join(smil, ["path", "media_overlay"]).select("path", "spine_idx", "chapter_href", "smil")


class Fragments(HTMLParser):
    """The text of each element that has an id, or that refers to one as a further part of it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.text = [], {}

    def handle_starttag(self, tag, attrs):
        if tag not in VOID:
            named = dict(attrs)
            self.open.append((tag, named.get("id") or named.get("data-sentence")))
            if self.open[-1][1]:
                self.text.setdefault(self.open[-1][1], "")

    def handle_endtag(self, tag):
        while any(t == tag for t, _ in self.open) and self.open.pop()[0] != tag:
            pass

    def handle_data(self, data):
        for name in {n for _, n in self.open if n}:
            self.text[name] += data


def fragments(chapters: DataFrame) -> DataFrame:
    """(chapter_id, fragment, text) of tagged chapters (chapter_id, xml): each unit's text, put together where inline markup split it."""

    @F.pandas_udf("array<struct<fragment:string,text:string>>")
    def run(xml: pd.Series) -> pd.Series:
        def one(x: str | None) -> list[dict]:
            p = Fragments()
            p.feed(x or "")
            p.close()
            return [{"fragment": k, "text": v} for k, v in p.text.items()]

        return xml.map(one)

    return chapters.select("chapter_id", F.explode(run("xml")).alias("f")).select("chapter_id", "f.*")


def with_text(clips: DataFrame, chapters: DataFrame) -> DataFrame:
    """Clips (text_href) with the text of the fragment that each points to, null where there is none: an equi-join on chapter and fragment, documents parsed once."""
    f = fragments(chapters.select(F.col("href").alias("chapter_id"), "xml")).withColumnsRenamed({"chapter_id": "_href", "text": "frag_text"})
    c = clips.withColumns({"_href": F.substring_index("text_href", "#", 1), "fragment": F.regexp_extract("text_href", "#(.*)$", 1)})
    return c.join(f, ["_href", "fragment"], "left").drop("_href", "fragment")


#: The class that a reading system gives to what is being read.
ACTIVE = "-epub-media-overlay-active"


def with_overlays(opf: bytes, overlays: list[tuple[str, str, float]], audio: list[tuple[str, str]], modified: str, tool: str, scripted: frozenset[str] = frozenset(), style: str | None = None) -> bytes:
    """The package document with overlays (chapter id, href, seconds) and audio files (href, type): time of change, contributor, durations and their sum, items, the `scripted` property where it is missing, and a stylesheet."""
    for prefix, uri in (("", "http://www.idpf.org/2007/opf"), ("dc", "http://purl.org/dc/elements/1.1/")):
        ET.register_namespace(prefix, uri)
    package = ET.fromstring(opf)
    space = package.tag[: package.tag.find("}") + 1]
    metadata, manifest = (next((e for e in package if local(e) == name), None) for name in ("metadata", "manifest"))
    if metadata is None or manifest is None:
        raise ValueError("a package needs metadata and a manifest")
    items = {e.get("id"): e for e in manifest if local(e) == "item"}

    def meta(name: str, text: str, **more) -> None:
        ET.SubElement(metadata, f"{space}meta", {"property": name, **more}).text = text

    def item(id_: str, href: str, kind: str) -> None:
        ET.SubElement(manifest, f"{space}item", {"id": id_, "href": href, "media-type": kind})

    clock = lambda x: f"{int(x // 3600)}:{int(x // 60) % 60:02d}:{x % 60:06.3f}"
    for e in [e for e in metadata if local(e) == "meta" and e.get("property") == "dcterms:modified"]:
        metadata.remove(e)
    meta("dcterms:modified", modified)
    ET.SubElement(metadata, "{http://purl.org/dc/elements/1.1/}contributor", {"id": "overlay-contributor"}).text = tool
    meta("role", "bkp", refines="#overlay-contributor", scheme="marc:relators")
    for id_ in sorted(scripted & set(items)):
        properties = (items[id_].get("properties") or "").split()
        if "scripted" not in properties:
            items[id_].set("properties", " ".join([*properties, "scripted"]))
    for chapter, href, seconds in overlays:
        if chapter not in items:
            raise ValueError(f"no manifest item {chapter}")
        items[chapter].set("media-overlay", f"{chapter}-overlay")
        meta("media:duration", clock(seconds), refines=f"#{chapter}-overlay")
        item(f"{chapter}-overlay", href, "application/smil+xml")
    meta("media:duration", clock(sum(s for _, _, s in overlays)))
    meta("media:active-class", ACTIVE)
    for i, (href, kind) in enumerate(sorted(set(audio))):
        item(f"audio-{i}", href, kind)
    if style:
        item("overlay-style", style, "text/css")
    return b'<?xml version="1.0" encoding="UTF-8"?>\n' + ET.tostring(package, encoding="utf-8")


def with_files(data: bytes, files: dict[str, bytes]) -> bytes:
    """The book with files replaced or added, written as write_epub() does."""
    old = zipfile.ZipFile(io.BytesIO(data))
    out = io.BytesIO()
    write_epub([*((n, old.read(n)) for n in old.namelist() if n not in files and n != "mimetype"), *files.items()], out)
    return out.getvalue()


def content_checksum(data: bytes) -> str:
    """SHA-256 of a book's content: its files by name, but for media and what changes from run to run (time of change, contributor)."""
    z = zipfile.ZipFile(io.BytesIO(data))
    whole = hashlib.sha256()
    for name in sorted(z.namelist()):
        if not re.search(r"\.(mp3|mp4|m4a|m4b|jpe?g|png|gif)$", name, re.I):
            text = re.sub(rb'<meta property="dcterms:modified">[^<]*</meta>|<dc:contributor[^>]*>[^<]*</dc:contributor>', b"", z.read(name))
            whole.update(name.encode() + b"\0" + text)
    return whole.hexdigest()


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """One row per EPUB file; a file that can't be used has an error and no chapters."""
    return _books(spark, path, BOOK, lambda book, _: [book])


def read_chapters(spark: SparkSession, path: str) -> DataFrame:
    return _books(spark, path, CHAPTER, lambda _, chapters: chapters)


def write_epub(files: list[tuple[str, bytes]], path: str | io.BytesIO) -> None:
    """mimetype first and stored, all else deflated, by name and with one date, so that equal books are equal files."""
    with zipfile.ZipFile(path, "w") as z:
        z.writestr(zipfile.ZipInfo("mimetype"), b"application/epub+zip", zipfile.ZIP_STORED)
        for name, data in sorted(files):
            if name != "mimetype":
                z.writestr(zipfile.ZipInfo(name), data, zipfile.ZIP_DEFLATED)


def read_clips(spark: SparkSession, path: str) -> DataFrame:
    """(smil, idx, track, clip_begin, clip_end, text_href) of every `par` with both an audio and a text."""
    from lectern.functions.times import seconds_of

    def run(frames):
        for f in frames:
            out = []
            for p, d in zip(f["path"], f["content"], strict=True):
                for par in (e for e in ET.fromstring(bytes(d)).iter() if local(e) == "par"):
                    kids = {local(k): k for k in par}
                    a, t = kids.get("audio"), kids.get("text")
                    if a is not None and t is not None and None not in (got := (a.get("src"), a.get("clipBegin"), a.get("clipEnd"), t.get("src"))):
                        out.append((p, len(out), *got))
            yield pd.DataFrame(out, columns=["smil", "idx", "track", "b", "e", "text_href"])

    c = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "smil string, idx int, track string, b string, e string, text_href string")
    return c.select("smil", "idx", "track", seconds_of(F.col("b")).alias("clip_begin"), seconds_of(F.col("e")).alias("clip_end"), "text_href")
