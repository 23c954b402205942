"""Main text of web pages by consensus host paths.

1. Each page is read once into blocks: the text of block elements outside noise (navigation, headers,
   footers, sidebars, notices, adverts, forms, scripts, styles, reader comments), each with the path of
   containers it stands in. A path is made of tags with their class or id, digits generalised to 0.
2. Containers of a page are scored by the text of their own blocks that is no link, and half of that of
   the containers inside; the best one, or the article or main element around it, gets the page's vote.
3. Spark counts votes by (host, path) and each host's path with the most votes wins (then the larger
   score, then the path).
4. Each page is read again with its host's path: blocks below it, in page order, are the text. A page
   that lacks the path, or keeps less than a quarter of its own best container's text with it, uses its
   own best container.

Votes are summed inside each batch and before their shuffle, so a host with any share of the pages is a
few rows a task. Winners are written once; where the table is small the planner sends it to all tasks,
else pages are joined by host, a join whose hot keys adaptive execution can split.

Cases: a null or empty page, or one of noise alone, has an empty text; a null url is a host of its own;
repeated pages each vote and are each returned; broken markup is read to its end (unclosed elements end
where their parent does, stray end tags are passed over); an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.llm.hosts import host
from foliary.operators.sizing import settled

_TAG = re.compile(
    r"<!--|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"
)
_ATTRIBUTE = re.compile(r"([^\s\"'=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp select svg math object canvas audio video".split())
NOISE_TAGS = frozenset("nav header footer aside form button dialog menu head label fieldset".split())
CONTAINERS = frozenset("body article main section div td center details dd blockquote".split())
BLOCKS = CONTAINERS | NOISE_TAGS | frozenset(
    "html address dl dt figcaption figure h1 h2 h3 h4 h5 h6 hr li ol p pre summary table tbody tfoot thead tr th ul caption".split()
)
#: Words of a class or id that mark noise.
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo banner sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "header footer masthead topbar cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup share "
    "sharing social comment comments disqus respond replies related recommended widget toolbar pagination pager copyright disclaimer "
    "login search".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: What an opening tag ends, up to the elements that bound it.
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
}
_P = (frozenset(["p"]), CONTAINERS | NOISE_TAGS | {"table", "li"})
#: An end tag of an inline element does not end a block.
_INLINE_BOUND = BLOCKS - {"p"}
#: Share of its own best container's text that a page must keep with its host's path.
KEEP_SHARE = 0.25

RESULT = "page_id long, url string, text string, n_chars long, path string"


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(text)}


def _is_noise(tag: str, given: dict[str, str]) -> bool:
    if tag in NOISE_TAGS:
        return True
    if given.get("role", "").lower() in NOISE_ROLES or "hidden" in given or given.get("aria-hidden", "").lower() == "true":
        return True
    if re.search(r"display\s*:\s*none", given.get("style", ""), re.I):
        return True
    marks = {w.lower() for w in _WORDS.findall(f"{given.get('class', '')} {given.get('id', '')}")}
    if tag in ("html", "body"):
        return False
    if tag in ("article", "main"):
        return bool(marks & {"comment", "comments", "related", "recommended", "sidebar", "ad", "ads"})
    return bool(marks & NOISE_WORDS)


def _key(tag: str, given: dict[str, str]) -> str:
    """Generalised step of a path: the tag with its class, or else its id."""
    name = ".".join(sorted(given.get("class", "").split())) or given.get("id", "")
    return f"{tag}.{re.sub('[0-9]+', '0', html.unescape(name))}".replace(">", "") if name else tag


class _Page:
    """Reads one page into `blocks`: (path, text, characters outside links)."""

    def __init__(self, source: str):
        self.source, self.blocks = source, []
        #: Open elements: (tag, noise, path, link).
        self.open: list[tuple[str, bool, str, bool]] = [("", False, "", False)]
        self.parts: list[str] = []
        self.plain = 0
        self.read()

    def flush(self) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            if text:
                self.blocks.append((self.open[-1][2], text, self.plain))
            self.parts, self.plain = [], 0

    def text(self, start: int, end: int) -> None:
        _, noise, _, link = self.open[-1]
        if start < end and not noise:
            part = self.source[start:end]
            self.parts.append(part)
            if not link:
                self.plain += len(part) - part.count(" ")

    def close(self, names: frozenset, bounds: frozenset) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] in names:
                self.flush()
                del self.open[i:]
                return
            if self.open[i][0] in bounds:
                return

    def begin(self, tag: str, attributes: str) -> None:
        if tag == "br":
            if not self.open[-1][1]:
                self.parts.append("\n")
            return
        if tag in BLOCKS:
            self.flush()
            self.close(*_P)
            if tag in ENDS:
                self.close(*ENDS[tag])
        if tag in VOID:
            return
        _, noise, path, link = self.open[-1]
        given = _attributes(attributes) if attributes.strip(" /") else {}
        if tag in CONTAINERS:
            path = f"{path}>{_key(tag, given)}"
        self.open.append((tag, noise or _is_noise(tag, given), path, link or tag == "a"))

    def end(self, tag: str) -> None:
        if tag == "br":
            return self.begin(tag, "")
        if tag in BLOCKS:
            self.flush()
            return self.close(frozenset([tag]), frozenset())
        return self.close_inline(tag)

    def close_inline(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                del self.open[i]
                # What stays open inside keeps its own state, but the ended element's link or noise ends.
                for j in range(i, len(self.open)):
                    name, noise, path, _ = self.open[j]
                    self.open[j] = (name, noise, path, self.open[j - 1][3] or name == "a")
                return
            if self.open[i][0] in _INLINE_BOUND:
                return

    def read(self) -> None:
        source, at, size = self.source, 0, len(self.source)
        while at < size:
            found = _TAG.search(source, at)
            if not found:
                break
            self.text(at, found.start())
            at = found.end()
            if found[0] == "<!--":
                stop = source.find("-->", at)
                at = size if stop < 0 else stop + 3
                continue
            tag = (found[2] or found[5] or "").lower()
            if not tag:
                continue
            if found[1] or found[4]:
                self.end(tag)
            elif tag in RAW:
                stop = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>", re.I).search(source, at)
                at = at if (found[3] or "").rstrip().endswith("/") else stop.end() if stop else size
            else:
                self.begin(tag, found[3] or found[6] or "")
        self.text(at, size)
        self.flush()


def best_path(blocks: list[tuple[str, str, int]]) -> tuple[str, float]:
    """The best container's path and score; an article or main element around it comes first."""
    scores: dict[str, float] = {}
    for path, _, plain in blocks:
        scores[path] = scores.get(path, 0.0) + plain
        outer = path.rpartition(">")[0]
        if outer:
            scores[outer] = scores.get(outer, 0.0) + plain / 2
    if not scores:
        return "", 0.0
    best = min(scores, key=lambda p: (-scores[p], p))
    steps = best.split(">")
    for kind in ("article", "main"):
        places = [i for i, step in enumerate(steps) if step.split(".")[0] == kind]
        if places:
            return ">".join(steps[: places[-1] + 1]), scores[best]
    return best, scores[best]


def _below(blocks: list[tuple[str, str, int]], path: str) -> list[str]:
    return [text for at, text, _ in blocks if at == path or at.startswith(f"{path}>")]


def main_text(source: str | None, winner: str | None) -> tuple[str, str]:
    """A page's text and the path it was taken from."""
    blocks = _Page(source or "").blocks
    own, _ = best_path(blocks)
    mine = " ".join(_below(blocks, own))
    if winner is None or winner == own:
        return mine, own
    text = " ".join(_below(blocks, winner))
    return (text, winner) if len(text) >= KEEP_SHARE * len(mine) and text else (mine, own)


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counted: dict[tuple[str, str], list[float]] = {}
        for name, source in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
            path, score = best_path(_Page(source.as_py() or "").blocks)
            if path:
                row = counted.setdefault((name, path), [0, 0])
                row[0] += 1
                row[1] += int(score)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in counted], pa.string()), pa.array([k[1] for k in counted], pa.string()),
                pa.array([v[0] for v in counted.values()], pa.int64()), pa.array([v[1] for v in counted.values()], pa.int64()),
            ],
            ["host", "path", "votes", "score"],
        )


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [main_text(source.as_py(), path) for source, path in zip(batch.column("html"), batch.column("winner").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("page_id"), batch.column("url"), pa.array([t for t, _ in found], pa.string()),
                pa.array([len(t) for t, _ in found], pa.int64()), pa.array([p for _, p in found], pa.string()),
            ],
            [field.split()[0] for field in RESULT.split(", ")],
        )


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, winner): the consensus path of each host."""
    votes = pages.select(host(F.col("url")).alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(
        _votes, "host string, path string, votes long, score long"
    )
    return votes.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("score").alias("score")).groupBy("host").agg(
        F.max_by("path", F.struct("votes", "score", "path")).alias("winner")
    )


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and the path used, for every page."""
    winners = settled(host_paths(pages))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"), host(F.col("url")).alias("host"),
    )
    return rows.join(winners, "host", "left").select("page_id", "url", "html", "winner").mapInArrow(_extracted, RESULT)
