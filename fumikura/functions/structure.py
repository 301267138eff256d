"""The structure of a page or a plain text: what is quoted, inserted, a heading, a note, a missing glyph.

A page becomes a list of fragments, a text a list of segments with flags; streams (the whole, narration, speech,
inserted texts) are filters over segments.  Brackets don't form a regular language and pages have to be parsed, so
these are Arrow UDFs over batches of texts; a text is one row, as everywhere.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fumikura.functions.text import COLOPHON

#: Paragraphs a quotation may go on without a repeated opening mark; paragraphs from which on it is an inserted text.
MAX_PARAGRAPHS, INSERTED = 150, 8
LOST = "〓"

# quotations ----------------------------------------------------------------------------------------------------------


def _events(paragraphs: list[str], marks: str) -> list[tuple[int, int, int, bool]]:
    """(paragraph, column, +1 or -1, whether the paragraph begins with it) of every bracket, notes left out."""
    out = []
    for i, p in enumerate(paragraphs):
        body = re.sub("［＃[^］]*］", lambda m: " " * len(m[0]), p)
        first = len(body) - len(body.lstrip())
        out += [(i, m.start(), 1 if m[0] == marks[0] else -1, m.start() == first and m[0] == marks[0]) for m in re.finditer(f"[{marks}]", body)]
    return out


def quotations(paragraphs: list[str], headings: list[int] = (), marks: str = "「」", most: int = MAX_PARAGRAPHS, inserted: int = INSERTED) -> list[tuple[str, tuple[int, int], tuple[int, int] | None]]:
    """(kind, (paragraph, column) of the opening mark, of the closing one) in the order of their openings.

    Kinds: ``speech``; ``embedded``, a quotation over ``inserted`` paragraphs or more; ``unclosed``, an opening mark
    without a partner; ``stray``, a closing mark without one (given in the place of both).  An opening mark that begins
    a paragraph inside a quotation repeats it.  A quotation is given up at a heading, or ``most`` paragraphs after its
    last repeated mark.  Quotations directly inside an embedded or given-up one are speech; deeper marks are text.
    """
    heads, found = sorted(headings), []
    held: list[tuple[int, int]] = []  # places of open marks, outermost first
    inner: list[tuple[int, tuple[int, int], tuple[int, int]]] = []  # depth and places of pairs inside
    clock = 0

    def settle(closed: tuple[int, int] | None, first: tuple[int, int]) -> None:
        """A chain has come to its end: what it is, and what of its inside counts."""
        if closed is None:
            found.extend(("unclosed", p, None) for p in held)
        else:
            found.append(("embedded" if closed[0] - first[0] + 1 >= inserted else "speech", first, closed))
        if closed is None or found[-1][0] == "embedded":
            found.extend(("speech", a, b) for depth, a, b in inner if depth == 2)
        held.clear()
        inner.clear()

    for i, col, sign, leads in [*_events(paragraphs, marks), (len(paragraphs), -1, 0, False)]:
        if held:
            k = bisect_right(heads, clock)
            limit = min(heads[k] if k < len(heads) else len(paragraphs) + 1, clock + most + 1)
            if sign == 0 or i > limit or i == limit and not (leads and sign > 0):
                settle(None, held[0])
            elif leads and i > held[-1][0]:
                clock = i
                continue
            elif leads and i == clock and i > held[0][0]:
                continue
        if sign > 0:
            if not held:
                clock = i
            held.append((i, col))
        elif sign < 0 and not held:
            found.append(("stray", (i, col), (i, col)))
        elif sign < 0:
            a = held.pop()
            if held:
                inner.append((len(held) + 1, a, (i, col)))
            else:
                settle((i, col), a)
    return sorted(found, key=lambda x: (x[1], x[0]))


_HEADING = re.compile("^[ 　]*［＃[^］]*見出し[^］]*］|［＃「[^」]*」は[大中小]見出し］")


def headings_of(paragraphs: list[str]) -> list[int]:
    return [i for i, p in enumerate(paragraphs) if _HEADING.search(p)]


def segments(text: str | None) -> list[dict]:
    """par, kind (text or head), text, in_said, in_emb: the text cut wherever a flag changes; notes are dropped."""
    paragraphs = (text or "").split("\n")
    heads = set(headings_of(paragraphs))
    spans = quotations(paragraphs, sorted(heads))
    change: dict[int, list[tuple[int, int, int]]] = {}
    for kind, a, b in spans:
        if kind in ("speech", "embedded"):
            k = kind == "embedded"
            change.setdefault(a[0], []).append((a[1], k, 1))
            change.setdefault(b[0], []).append((b[1] + 1, k, -1))
    flags, out = [0, 0], []
    for i, p in enumerate(paragraphs):
        at = 0
        for col, k, d in [*sorted(change.get(i, [])), (len(p), 0, 0)]:
            piece = re.sub("［＃[^］]*］", "", p[at:col])
            if piece:
                out.append({"par": i, "kind": "head" if i in heads else "text", "text": piece, "in_said": flags[0] > 0, "in_emb": flags[1] > 0})
            at = col
            flags[k] += d
    return out


SEGMENT = T.ArrayType(T.StructType([T.StructField("par", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("in_said", T.BooleanType()), T.StructField("in_emb", T.BooleanType())]))


@F.pandas_udf(SEGMENT)
def segments_of(s: pd.Series) -> pd.Series:
    return s.map(segments)


STREAMS = ("full", "narration", "speech", "embedded")


def stream(segs: Column, which: str, narration_without_inserted: bool = False) -> Column:
    """The text of one stream: segments that belong to it, paragraph by paragraph."""
    said, emb = (lambda x: x["in_said"]), (lambda x: x["in_emb"])
    keep = {
        "full": lambda x: F.lit(True), "narration": lambda x: ~said(x) & ~(emb(x) & F.lit(narration_without_inserted)),
        "speech": lambda x: said(x) & (x["kind"] != "head"), "embedded": lambda x: emb(x) & (x["kind"] != "head"),
    }[which]
    kept = F.filter(segs, keep)
    joined = F.aggregate(kept, F.struct(F.lit("").alias("t"), F.lit(-1).alias("p")), lambda acc, x: F.struct(F.concat(acc["t"], F.when((acc["p"] >= 0) & (acc["p"] != x["par"]), "\n").otherwise(""), x["text"]).alias("t"), x["par"].alias("p")))
    return joined["t"]


def streams(docs: DataFrame, key: str = "doc_id", text: str = "text", narration_without_inserted: bool = False) -> DataFrame:
    """key, stream, text of the four streams of every text; inserted texts belong to the narration unless asked not to."""
    s = docs.select(key, segments_of(text).alias("_s"))
    return s.select(key, F.explode(F.array(*(F.struct(F.lit(w).alias("stream"), stream(F.col("_s"), w, narration_without_inserted).alias("text")) for w in STREAMS))).alias("x")).select(key, "x.stream", "x.text")


def framing(streams_: DataFrame, key: str = "doc_id", least: int = 3000) -> DataFrame:
    """Inserted text against narration of each text: characters (line breaks left out), the inserted share, and pronouns per 10,000
    characters of both; texts with fewer inserted characters than ``least`` are left out."""
    n = lambda c: F.length(F.replace(F.col(c), F.lit("\n"), F.lit("")))
    per = lambda c, w: F.round((F.length(F.col(c)) - F.length(F.replace(F.col(c), F.lit(w), F.lit("")))) / len(w) / F.greatest(n(c), F.lit(1)) * 1e4, 1)
    p = streams_.where("stream in ('embedded', 'narration')").groupBy(key).pivot("stream", ["embedded", "narration"]).agg(F.first("text"))
    p = p.where(n("embedded") >= least)
    return p.select(key, n("embedded").alias("inserted_chars"), n("narration").alias("narration_chars"), F.round(n("embedded") / F.greatest(F.lit(1), n("embedded") + n("narration")), 3).alias("inserted_share"), per("embedded", "私").alias("i_inserted"), per("narration", "私").alias("i_narration"))


def rendered(text: str | None) -> list[dict]:
    """Each paragraph's parts of quotations: kind, text and whether it is all of one (W), its first (I), a middle (M) or
    its last part (F)."""
    paragraphs = (text or "").split("\n")
    out = []
    for kind, a, b in quotations(paragraphs, headings_of(paragraphs)):
        if kind in ("speech", "embedded"):
            for i in range(a[0], b[0] + 1):
                lo, hi = a[1] if i == a[0] else 0, b[1] + 1 if i == b[0] else len(paragraphs[i])
                part = "W" if a[0] == b[0] else "I" if i == a[0] else "F" if i == b[0] else "M"
                if hi > lo:
                    out.append({"par": i, "kind": kind, "part": part, "text": paragraphs[i][lo:hi]})
    return out


RENDERED = T.ArrayType(T.StructType([T.StructField("par", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("part", T.StringType()), T.StructField("text", T.StringType())]))


@F.pandas_udf(RENDERED)
def rendered_of(s: pd.Series) -> pd.Series:
    return s.map(rendered)


def scan_events(paragraphs: Column, marks: str = "「」", most: int = MAX_PARAGRAPHS) -> Column:
    """Events of an array of paragraphs, as (kind, paragraph from 1): ``stray_close``; ``spans_too_many``, a quotation
    over ``most`` paragraphs; ``line_imbalance``, two or more marks too many of one kind; ``block_boundary``, one that
    a heading cuts off; ``unclosed_at_end``.  One pass with a depth, as an aggregate over the paragraphs' marks."""
    event = "struct<kind:string,par:int>"
    none = F.array().cast(f"array<{event}>")
    ev = lambda kind, par: F.struct(F.lit(kind).alias("kind"), par.cast("int").alias("par"))
    add = lambda acc, cond, kind, par: F.when(cond, F.array_append(acc, ev(kind, par))).otherwise(acc)

    def paragraph(acc: Column, x: Column) -> Column:
        par = acc["par"] + 1
        cut = (acc["depth"] > 0) & x.rlike("［＃[^］]*見出し")
        start = F.struct(F.when(cut, 0).otherwise(acc["depth"]).alias("depth"), acc["opened"].alias("opened"), add(acc["out"], cut, "block_boundary", acc["opened"]).alias("out"))

        def mark(a: Column, c: Column) -> Column:
            opens = c == marks[0]
            stray = ~opens & (a["depth"] == 0)
            closes = ~opens & (a["depth"] == 1)
            out = add(add(a["out"], stray, "stray_close", par), closes & (par - a["opened"] >= most), "spans_too_many", a["opened"])
            return F.struct((a["depth"] + F.when(opens, 1).when(stray, 0).otherwise(-1)).alias("depth"), F.when(opens & (a["depth"] == 0), par).otherwise(a["opened"]).alias("opened"), out.alias("out"))

        z = F.aggregate(F.regexp_extract_all(x, F.lit(f"([{marks}])"), F.lit(1)), start, mark)
        count = lambda m: F.length(x) - F.length(F.replace(x, F.lit(m), F.lit("")))
        return F.struct(par.alias("par"), z["depth"].alias("depth"), z["opened"].alias("opened"), add(z["out"], F.abs(count(marks[0]) - count(marks[1])) > 1, "line_imbalance", par).alias("out"))

    first = F.struct(F.lit(0).alias("par"), F.lit(0).alias("depth"), F.lit(0).alias("opened"), none.alias("out"))
    return F.aggregate(paragraphs, first, paragraph, lambda a: add(a["out"], a["depth"] > 0, "unclosed_at_end", a["opened"]))


#: Signs of a mark left open or closed twice, found in a line by themselves.
APPROXIMATE = {"A": "「[^「」\\n]*$", "B": "^[^「」\\n]*」", "C": "「[^「」\\n]*「", "D": "」[^「」\\n]*」", "E": "「(?=[、。）])"}


def approximate(line: Column) -> dict[str, Column]:
    return {k: line.rlike(p) for k, p in APPROXIMATE.items()}


# pages ---------------------------------------------------------------------------------------------------------------

_DIV = re.compile("<(/?)div\\b[^>]*>", re.I)
_MAIN = re.compile("<div[^>]*main_text[^>]*>", re.I)
_BACK = re.compile("<div[^>]*(?:bibliographical_information|notation_notes|after_text)", re.I)
_RULE = re.compile("<hr\\b[^>]*>", re.I)


def without_surplus(html: str) -> tuple[str, int]:
    """The page without closing tags that would end its main division early, and how many there were.

    Closing tags at which the running number of open divisions falls below all it was before end the main division;
    the last of them is its own, the others are surplus."""
    m = _MAIN.search(html)
    if not m:
        return html, 0
    back = _BACK.search(html, m.end())
    tags = list(_DIV.finditer(html, m.end(), back.start() if back else len(html)))
    open_ = np.cumsum([1, *(-1 if t[1] else 1 for t in tags)])
    low = np.flatnonzero((open_[1:] < np.minimum.accumulate(open_)[:-1]) & (open_[1:] < 1))[:-1]
    for k in low[::-1]:
        html = html[: tags[k].start()] + html[tags[k].end() :]
    return html, len(low)


def without_frame(html: str) -> str:
    """A page of the old layout, which has rules instead of divisions: what stands between the rules of its first
    twentieth and the first rule past its first fifth that a colophon follows within 400 characters."""
    rules = list(_RULE.finditer(html))
    if _MAIN.search(html) or not rules:
        return html
    colophon = lambda r: any(m in re.sub("<[^>]+>", "", html[r.end() : r.end() + 400]) for m in COLOPHON)
    end = next((r.start() for r in rules if r.start() >= len(html) * 0.2 and colophon(r)), len(html))
    body = re.search("<body[^>]*>", html, re.I)
    start = body.end() if body else 0
    front = start + (end - start) // 20
    for r in rules if body else ():
        if not start < r.start() < front:
            break
        start = r.end()
    return f'{html[:start]}<div class="main_text">{html[start:end]}</div></body></html>' if end > start else html


_PLACE = re.compile("([12])-([0-9]{1,2})-([0-9]{1,2})")
_VOID = ("br", "img", "hr", "meta", "link", "input")


def glyph_at(plane: int, row: int, cell: int) -> str | None:
    """The character at a place of JIS X 0213."""
    try:
        return bytes([0x8F] * (plane - 1) + [row + 0xA0, cell + 0xA0]).decode("euc_jis_2004")
    except (UnicodeDecodeError, ValueError):
        return None


def glyph_of(note: str) -> str | None:
    """The character a note on a missing glyph names: by its place in the standard, else by its code point."""
    m = _PLACE.search(note)
    ch = glyph_at(*map(int, m.groups())) if m else None
    u = re.search("U\\+([0-9A-Fa-f]{4,5})", note)
    return ch or (chr(int(u[1], 16)) if u else None)


class _Walk(HTMLParser):
    """Fragments of the main division: text, ruby (with its reading), glyph, note, break, head."""

    def __init__(self, main: bool):
        super().__init__(convert_charrefs=True)
        self.main, self.out, self.stack = main, [], []

    def _inside(self, role: str) -> bool:
        return any(role in r for _, r in self.stack)

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        name = f"{a.get('class') or ''} {a.get('id') or ''}"
        if tag == "br":
            self._add("break", "\n")
        if tag == "img" and ("gaiji" in name or "※" in (a.get("alt") or "")):
            alt = a.get("alt") or ""
            bare = re.sub("[※（）()]|[、,].*$", "", alt)
            self._add("glyph", glyph_of(alt) or (bare if len(bare) == 1 else None) or glyph_of(a.get("src") or "") or LOST, alt)
        if tag in _VOID:
            return
        role = set()
        if ("main_text" in name) if self.main else tag == "body":
            role.add("main")
        if tag in ("script", "style", "rp") or any(x in name for x in ("bibliographical", "notation_notes", "after_text")):
            role.add("skip")
        if tag in ("rt", "ruby"):
            role.add(tag)
        if "notes" in name and tag == "span":
            role.add("note")
        if re.fullmatch("h[1-6]", tag):
            role.add("head")
        if tag == "ruby":
            self._add("ruby", "", "")
        self.stack.append((tag, role))

    def handle_endtag(self, tag):
        if tag in [t for t, _ in self.stack]:
            while self.stack.pop()[0] != tag:
                pass
            if re.fullmatch("h[1-6]|p|div", tag):
                self._add("break", "\n")

    def handle_data(self, data):
        if self._inside("note"):
            self._note(data)
        elif self._inside("skip"):
            return
        elif self._inside("ruby") and self.out and self.out[-1]["kind"] == "ruby":
            self.out[-1]["extra" if self._inside("rt") else "text"] += data if self._inside("main") else ""
        else:
            self._add("head" if self._inside("head") else "text", data)

    def _add(self, kind, text, extra=None):
        if self._inside("main") and not self._inside("skip"):
            self.out.append({"kind": kind, "text": text, "extra": extra})

    def _note(self, data):
        """A note names the glyph that the last mark ※ of the six fragments before stands for, unless it quotes one."""
        if "※" not in data:
            for f in self.out[-1:-7:-1]:
                k = f["text"].rfind("※")
                if k >= 0 and f["kind"] in ("text", "ruby", "head"):
                    f["text"] = f["text"][:k] + (glyph_of(data) or LOST) + f["text"][k + 1 :]
                    break
        self._add("note", "", data)


def fragments(html: str | None) -> list[dict]:
    """kind, text, extra (reading of ruby, note, description of a glyph) of a page's main text; the old layout is
    framed first and surplus closing tags are dropped.  Text is what is left without readings and notes."""
    if html is None:
        return []
    page, _ = without_surplus(without_frame(html))
    w = _Walk(bool(_MAIN.search(page)))
    w.feed(page if "<body" in page or w.main else f"<body>{page}</body>")
    w.close()
    return w.out


FRAGMENT = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("extra", T.StringType())]))


@F.pandas_udf(FRAGMENT)
def fragments_of(s: pd.Series) -> pd.Series:
    return s.map(fragments)


@F.pandas_udf(T.IntegerType())
def surplus_of(s: pd.Series) -> pd.Series:
    return s.map(lambda h: None if h is None else without_surplus(h)[1])


def glyph_map(definitions: DataFrame) -> DataFrame:
    """(glyph_id, ch) from rows (glyph_id, type, value): a standard character if there is one, else the code point of
    the private use area."""
    std = F.max(F.when((F.lower("type") == "standard") & (F.trim("value") != ""), F.trim("value")))
    pua = F.max(F.when((F.lower("type") == "pua") & F.col("value").rlike("^U\\+[0-9A-Fa-f]{4,5}$"), F.decode(F.unhex(F.lpad(F.substring(F.trim("value"), 3, 5), 8, "0")), "UTF-32")))
    return definitions.where("glyph_id <> ''").groupBy("glyph_id").agg(F.coalesce(std, pua).alias("ch")).where("ch is not null")
