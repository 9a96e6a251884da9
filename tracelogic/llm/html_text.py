"""Main text of web pages from parser events and text-to-tag ratios.

The standard library's streaming parser gives events. Text between block-level tags is a line; a line's ratio is its
characters over its tags, links weighing against it. Ratios are smoothed with a Gaussian over neighbouring lines. Each
line is a point: its smoothed ratio, and by how much the lines after it differ from it. Points are clustered with one
cluster held at the origin; lines of the other clusters are content. The region is the smallest element that holds all
content lines, or the article or main element around it; where articles that aren't in one main element hold most of
the content, they are joined, and content outside them is kept line by line. Headings and paragraphs beside the region
stay, and so do the short lines inside it.

Menus, footers, sidebars, forms and the like go by tag and role. Class names and ids only support the ratios: an
element with such a name goes if its text isn't content or is mostly links; if the whole name says so (comments,
cookie-notice) it goes in any case, unless it holds most of the page's text or its title.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose text is never the article's.
DROPPED = frozenset("head script style noscript template nav footer aside form button select option textarea input label iframe object svg math canvas audio video menu dialog".split())
#: A start tag that ends an open element of the second kind.
CLOSES = {**dict.fromkeys(BLOCK - {"li", "dd", "dt", "td", "th", "tr"}, ("p",)), "li": ("p", "li"), "dd": ("p", "dd", "dt"), "dt": ("p", "dd", "dt"), "td": ("p", "td", "th"), "th": ("p", "td", "th"), "tr": ("p", "td", "th", "tr")}
SCOPE = frozenset("table ul ol dl div article section main body td th blockquote aside nav header footer form".split())
#: Inside head; any other start tag ends it.
HEAD = frozenset("base link meta noscript script style template title".split())
#: What class names and ids of other parts than the article are made of, what may stand beside it in
#: a name that says so as a whole, and what says that a part is beside an element or open, not what the element is.
NAMED = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disqus footer gdpr masthead menu menubar modal nav navbar navigation newsletter notice "
    "pagination pager popup promo promos promotion recommended recommendations related replies respond share sharing sidebar skip social sponsor sponsored sponsors subscribe toolbar topbar widget".split()
)
AROUND = frozenset("area bar block bottom box container footer global header inner left link links list main page primary right secondary section site slot thread top unit wrap wrapper web".split())
MODIFIER = re.compile(r"(?:^|(?<=[-_]))(?:has|have|no|not|with|without|open|closed|enabled|disabled|on|off)(?:$|[-_])")
#: Headers are the site's unless they are an entry's.
ENTRY = frozenset("entry post article content story section".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
SPACE = re.compile(r"\s+")


def named(tokens: str, inside: bool) -> int:
    """2 where a class name or id as a whole names another part than the article, 1 where it has such a word, else 0."""
    found = 0
    for token in tokens.lower().split():
        if MODIFIER.search(token):
            continue
        parts = [re.sub(r"\d+$", "", x) for x in re.split(r"[-_]+", token)]
        header = not inside and not ENTRY.intersection(parts) and ("header" in parts)
        hits = [x for x in parts if x in NAMED] + ["header"] * header
        if hits:
            found = max(found, 2 if all(x in NAMED or x in AROUND or not x for x in parts) else 1)
    return found


class Lines(HTMLParser):
    """Collects lines outside dropped elements: (text, tags, link characters, elements that hold it)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, tuple[int, ...]]] = []
        self.open: list[tuple[str, int, bool]] = []  # tag, number, dropped
        self.kind: list[str] = []  # tag of each element number
        self.names: dict[int, int] = {}  # elements whose names speak against them, and how much
        self.text: list[str] = []
        self.tags = self.links = 0

    def flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.text)).strip()
        if text:
            self.lines.append((text, self.tags, self.links, tuple(n for _, n, _ in self.open)))
        self.text, self.tags, self.links = [], 0, 0

    def handle_starttag(self, tag, attrs):
        if tag == "body" or tag not in HEAD and any(t == "head" for t, _, _ in self.open):
            while self.open and self.open[-1][0] != "html":
                self.open.pop()
        if tag in BLOCK:
            self.flush()
            for old in CLOSES.get(tag, ()):
                for i in range(len(self.open) - 1, -1, -1):
                    if self.open[i][0] == old:
                        del self.open[i:]
                        break
                    if self.open[i][0] in SCOPE:
                        break
        elif tag == "br":
            self.text.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        dropped = bool(self.open and self.open[-1][2])
        inside = any(t in ("article", "main") for t, _, _ in self.open)
        if not dropped and tag not in ("html", "body"):
            a = dict(attrs)
            dropped = tag in DROPPED or (tag == "header" and not inside) or (a.get("role") or "").lower() in ROLES or "hidden" in a
            against = named(f"{a.get('class') or ''} {a.get('id') or ''}", inside)
            if against and tag not in ("article", "main") and tag not in HEADING:
                self.names[len(self.kind)] = against
        self.open.append((tag, len(self.kind), dropped))
        self.kind.append(tag)

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.flush()
        self.tags += 1
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break
            if tag not in BLOCK and self.open[i][0] in BLOCK:
                break

    def handle_data(self, data):
        if self.open and self.open[-1][2]:
            return
        self.text.append(data)
        if any(t == "a" for t, _, _ in self.open[-4:]):
            self.links += len(data.strip())


def smooth(values: list[float], sigma: float = 1.0, radius: int = 2) -> list[float]:
    """Gaussian smoothing; the kernel is cut and renormalised at the ends."""
    kernel = [math.exp(-(j * j) / (2 * sigma * sigma)) for j in range(-radius, radius + 1)]
    out = []
    for i in range(len(values)):
        part = [(kernel[j + radius], values[i + j]) for j in range(-radius, radius + 1) if 0 <= i + j < len(values)]
        out.append(sum(k * v for k, v in part) / sum(k for k, _ in part))
    return out


def ratios(lines: list) -> list[float]:
    """Text-to-tag ratios."""
    return [max(0, len(t) - links) / max(1, tags) for t, tags, links, _ in lines]


def cluster(raw: list[float], ahead: int = 3, rounds: int = 20) -> tuple[list[bool], list[bool]]:
    """Which lines are content, and which of them by their own ratio too, not only by that of their neighbours.

    k-means over (smoothed ratio, change), where one of three centres stays at the origin and isn't content.
    """
    n, ratio = len(raw), smooth(raw)
    change = smooth([abs(sum(ratio[i : i + ahead + 1]) / len(ratio[i : i + ahead + 1]) - ratio[i]) for i in range(n)])
    points = list(zip(ratio, change, strict=True))
    centres = [(0.0, 0.0), (max(ratio), 0.0), (sum(ratio) / n, max(change))]
    nearest = lambda r, d: min(range(3), key=lambda c: (r - centres[c][0]) ** 2 + (d - centres[c][1]) ** 2)
    own: list[int] = []
    for _ in range(rounds):
        now = [nearest(r, d) for r, d in points]
        if now == own:
            break
        own = now
        for c in (1, 2):
            held = [p for p, o in zip(points, own, strict=True) if o == c]
            if held:
                centres[c] = (sum(p[0] for p in held) / len(held), sum(p[1] for p in held) / len(held))
    return [o > 0 for o in own], [o > 0 and nearest(x, 0.0) > 0 for o, x in zip(own, raw, strict=True)]


def against(lines: list, content: list[bool], names: dict[int, int], kind: list[str]) -> set[int]:
    """Elements that go by their names."""
    mass: dict[int, list[int]] = {e: [0, 0, 0, 0] for e in names}  # text, links, content, titles
    whole, marked = 0, {e: 0 for e in names}  # text in article or main elements elsewhere
    for (text, _, links, path), c in zip(lines, content, strict=True):
        whole += len(text) - links
        if any(kind[n] in ("article", "main") for n in path):
            for e in names:
                marked[e] += 0 if e in path else len(text) - links
        for n in path:
            if n in mass:
                m = mass[n]
                m[0], m[1], m[2] = m[0] + len(text), m[1] + links, m[2] + (len(text) - links if c else 0)
                m[3] += any(kind[x] == "h1" for x in path)
    out = set()
    for e, (text, links, held, titles) in mass.items():
        if titles or (2 * (text - links) > whole and not marked[e]):
            continue
        if names[e] == 2 or 3 * links >= text or 2 * held < text:
            out.add(e)
    return out


def region(lines: list, content: list, kind: list[str]) -> list[bool]:
    """Which lines are of the region of ``content``, or beside it."""
    weigh = lambda xs: sum(max(0, len(x[0]) - x[2]) for x in xs)
    # headings don't widen the region; those of the content are kept in any case
    head = lambda x: any(kind[n] in HEADING for n in x[3])
    body = [x for x in content if not head(x)] or content
    whole = body[0][3]
    for x in body:
        n = 0
        while n < min(len(whole), len(x[3])) and whole[n] == x[3][n]:
            n += 1
        whole = whole[:n]
    marked = lambda path: [i for i, n in enumerate(path) if kind[n] in ("article", "main")]
    within = marked(whole)
    # the paths of what is kept whole, and the lines kept besides
    cores, single = {whole[: within[-1] + 1] if within else whole}, [x for x in content if head(x)]
    if not within:
        while whole and (kind[whole[-1]] not in BLOCK or kind[whole[-1]] == "p" or kind[whole[-1]] in HEADING):
            whole = whole[:-1]
        cores = {whole}
        if 2 * weigh([x for x in content if marked(x[3])]) >= weigh(content):
            cores = {x[3][: marked(x[3])[0] + 1] for x in content if marked(x[3])}
            single = [x for x in content if head(x) or not marked(x[3])]
    held = {path[-1] for path in cores if path}
    above = {n for path in cores for n in path[:-1]} | {n for x in single for n in x[3] if kind[n] not in ("p", *HEADING)}
    kept = {id(x) for x in single}

    def child(path: tuple[int, ...]) -> tuple[int | None, str]:
        """The block element that holds a line under the last element that also holds something kept, and that one's tag."""
        at = max((i for i, n in enumerate(path) if n in above), default=-1)
        return next((n for n in path[at + 1 :] if kind[n] in BLOCK), None), kind[path[at]] if at >= 0 else "body"

    def prose(x) -> bool:
        blocks = [kind[n] for n in x[3] if kind[n] in BLOCK]
        return bool(blocks) and (blocks[-1] == "p" or blocks[-1] in HEADING)

    rest: dict[int, list] = {}
    for x in lines:
        if () in cores or not held.isdisjoint(x[3]):
            kept.add(id(x))
        elif id(x) not in kept:
            n, _ = child(x[3])
            if n is None:
                # text without an element of its own is a paragraph
                if not x[2]:
                    kept.add(id(x))
            else:
                rest.setdefault(n, []).append(x)
    for n, xs in rest.items():
        direct = kind[n] == "p" or kind[n] in HEADING
        outer = child(xs[0][3])[1] in ("html", "body")
        wrapped = all(prose(x) and 2 * x[2] <= len(x[0]) for x in xs) and (not outer or any(kind[m] in HEADING for x in xs for m in x[3]))
        if direct or wrapped:
            kept.update(id(x) for x in xs)
    return [id(x) in kept for x in lines]


def main_text(html: str | None) -> str:
    """The page's main text; lines are joined by an empty line."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    lines = parser.lines
    if not lines:
        return ""
    content, sure = cluster(ratios(lines))
    gone = against(lines, content, parser.names, parser.kind)
    left = [(x, c, s) for x, c, s in zip(lines, content, sure, strict=True) if gone.isdisjoint(x[3])]
    lines = [x for x, _, _ in left]
    if not lines:
        return ""
    content = [x for x, _, s in left if s] or [x for x, c, _ in left if c] or lines
    # lines of links alone have no mass of their own
    keep = region(lines, [x for x in content if len(x[0]) > x[2]] or content, parser.kind)
    return "\n\n".join(x[0] for x, k in zip(lines, keep, strict=True) if k)


def extract(pages: DataFrame) -> DataFrame:
    """Per row of pages: page_id, url, text, n_chars.

    Null and empty html, and pages without text, give an empty text. Broken markup is read as far as the parser's
    events go; nothing is cut. Rows that repeat are answered one by one; extra columns are ignored.
    """

    def run(batches):
        for b in batches:
            text = pa.array([main_text(h) for h in b.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), text], ["page_id", "url", "text"])

    source = pages.select("page_id", "url", "html")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema[:2])
    return source.mapInArrow(run, f"{schema}, text string").withColumn("n_chars", F.length("text").cast("long"))
