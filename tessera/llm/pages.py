"""Main text of web pages by site style trees.

The DOMs of a host's pages are merged: a node of the tree is a path of tags with their classes and ids.  A node's
presentation matters if its children's styles differ between pages, its contents matter if they do: a text that stands
on c of a node's m pages has the importance 1 - log c / log m.  Presentation and contents are composed, and branches of
low importance go from every page of the host, and so do single texts, inside article and main elements as elsewhere.
What the markup itself says to be a menu, footer, form or the like by its element or role is of no importance.  Classes
and ids that name such parts (comments, adverts, ...) are a prior: the part goes unless the tree finds in it a branch of
high importance that holds a good part of the pages' text, and stays if it holds a main element, the page's only article
or most of the page's text.  On a page with an article or main element, what stands outside of it stays only by the tree: in a branch of high importance
that holds a good part of the pages' text.  Where the tree has judged nothing, and where it would leave nothing of an
article, the markup decides.

Cases: null and empty html gives an empty text; null or unreadable urls have no tree and are judged by their markup;
markup may be cut off, unclosed or badly nested; repeated rows are pages of their own; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import small_batches
from tessera.session import materialize


@dataclass(frozen=True)
class Params:
    """threshold: importance below which a branch goes; min_pages: pages a node needs to be judged; attenuation: the
    share of contents in a node's importance; depth: of the tree, DEPTH at most; broadcast_rows: up to so many branches are sent to all tasks; strong and
    share: importance and mean share of its pages' text from which a branch stays against the markup."""

    threshold: float = 0.3
    min_pages: int = 5
    attenuation: float = 0.9
    depth: int = 8
    broadcast_rows: int = 100_000
    strong: float = 0.7
    share: float = 0.25


TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|</?[a-zA-Z][^\s/>]*(?:\"[^\"]*\"|'[^']*'|[^>\"'])*>|[^<]+|<", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""")

# Element names of HTML by their kind.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg object".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCK - {"html", "body"}
SAME_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = frozenset("ul ol dl table tr menu dir".split())
# Names by which pages mark what is not the article.
NOISE_TAGS = frozenset("nav footer aside form button select input label dialog head menu".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies "
    "disqus dialog footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay "
    "pager pagination popup promo promotion related reply replies respond search share sharing sidebar signup skip social sponsor "
    "sponsored subscribe subscription toolbar widget".split()
)
WHOLE = frozenset({"article", "main"})

#: Elements of a path, the most that a tree can be deep; what lies deeper belongs to the last of them.
DEPTH = 8


class Element:
    __slots__ = ("main", "name", "named", "noise", "path")

    def __init__(self, name: str, path: str, noise: bool, main: bool, named: tuple[tuple[int, int], ...] = ()):
        self.name, self.path, self.noise, self.main, self.named = name, path, noise, main, named


def is_noise(name: str, attrs: dict[str, str], within_main: bool) -> bool:
    if name in NOISE_TAGS or (name == "header" and not within_main):
        return True
    return bool(attrs) and ("hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in NOISE_ROLES or "display:none" in attrs.get("style", "").replace(" ", "").lower())


def is_named(name: str, attrs: dict[str, str]) -> bool:
    """Whether a whole class or id is a name of noise, or made of such names only: cookie-banner, but not no-sidebar."""
    if not attrs or name in ("html", "body"):
        return False
    for token in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        words = set(re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", token).lower())) - {""}
        if words and words <= NOISE_WORDS:
            return True
    return False


def blocks(text: str | None) -> tuple[list[tuple[str, str, bool, int]], bool]:
    """((path, text, whether inside an article or main element, level) of every block outside of noise elements, in page
    order; whether such an element was met outside of named parts).  The level is that of the innermost part above the
    block that a class or id names as noise, as a number of branches; 0 for none."""
    out: list[tuple[str, str, bool, tuple[tuple[int, int], ...]]] = []
    met: list[tuple[str, tuple[tuple[int, int], ...]]] = []
    parts = 0
    stack: list[Element] = [Element("", "", False, False)]
    opened: dict[str, int] = {}
    buffer: list[str] = []
    raw: str | None = None

    def flush() -> None:
        if buffer:
            if not (top := stack[-1]).noise and (t := " ".join(entities.unescape("".join(buffer)).split())):
                out.append((top.path, t, top.main, top.named))
            buffer.clear()

    def innermost(names: set[str], stop: frozenset[str]) -> int:
        """Where the innermost open element of these names stands, unless one to stop at is met first; 0 if nowhere.
        Elements that are not open are not looked for, so deep and unclosed markup takes no longer than other."""
        if any(opened.get(x) for x in names):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in names:
                    return i
                if stack[i].name in stop:
                    break
        return 0

    def close(at: int) -> None:
        for e in stack[at:] if at else ():
            opened[e.name] -= 1
        if at:
            del stack[at:]

    for m in TOKEN.finditer(text or ""):
        x = m[0]
        if x[0] != "<" or len(x) == 1:
            if raw is None and not stack[-1].noise:
                buffer.append(x)
            continue
        if x[1] in "!?":
            continue
        if (n := NAME.match(x)) is None:
            continue
        name = n[1].lower()
        if x[1] == "/":
            if raw is not None:
                raw = None if name == raw else raw
                continue
            at = innermost({name}, frozenset() if name in BLOCK else BLOCK)
            if name in BLOCK or (at and (stack[at].noise != stack[at - 1].noise or stack[at].named != stack[at - 1].named)):
                flush()
            close(at)
            continue
        if raw is not None:
            continue
        if name in RAW:
            raw = None if x.endswith("/>") else name
            continue
        if name in BLOCK:
            flush()
            if name in ENDS_P:
                close(innermost({"p"}, BLOCK))
            if name in SAME_ENDS:
                close(innermost(SAME_ENDS[name], HOLDS | WHOLE))
        if name in VOID:
            if name == "br":
                buffer.append(" ")
            continue
        if x.endswith("/>") and name not in BLOCK:
            continue
        attrs = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(x[n.end() :])} if len(x) > n.end() + 1 else {}
        top = stack[-1]
        noise = top.noise or is_noise(name, attrs, top.main)
        named = not noise and is_named(name, attrs)
        if (noise and not top.noise) or named:
            flush()
        whole = name if name in WHOLE else attrs.get("role")
        main = top.main or (whole in WHOLE and not noise)
        if name in BLOCK:
            mark = f"{name}.{attrs.get('class', '')}#{attrs.get('id', '')}" if attrs else name
            path = f"{top.path}>{mark}" if top.path.count(">") < DEPTH else top.path
        else:
            path = top.path
        above = top.named
        if named:
            parts += 1
            above = (*above, (parts, path.count(">") if path != top.path else top.path.count(">") + 1))
        if whole in WHOLE and not noise:
            met.append((whole, above))
        stack.append(Element(name, path, noise, main, above))
        opened[name] = opened.get(name, 0) + 1
    flush()
    size: dict[int, int] = {}
    for _, t, _, named in out:
        for part, _ in named:
            size[part] = size.get(part, 0) + len(t)
    total = sum(len(t) for _, t, _, _ in out)
    alone = all(named for _, named in met)  # else articles in named parts are comments, teasers and the like
    stays = {part for part, n in size.items() if 2 * n > total}
    stays |= {part for kind, named in met if kind == "main" or alone for part, _ in named}
    found = [(path, t, main, max((level for part, level in named if part not in stays), default=0)) for path, t, main, named in out]
    return found, any(all(part in stays for part, _ in named) for _, named in met)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def _key(path: str) -> int:
    return xxhash.xxh64_intdigest(path) - 2**63


def _branches(path: str, depth: int) -> list[str]:
    """The branches above a block, outermost first."""
    parts = path.split(">")[1 : depth + 1]
    return [">".join(parts[:i]) for i in range(1, len(parts) + 1)]


def _leaf(branch: str, text: str) -> int:
    return _key(f"{branch}\n{text}")


@dataclass
class Page:
    """A parsed page: of each block the hashes of the branches above it (outermost first), that of its text in the innermost
    one, the text, whether it stands in an article or main element, and its level (see blocks)."""

    keys: list[list[int]]
    leaves: list[int]
    texts: list[str]
    main: list[bool]
    levels: list[int]
    has_main: bool


def parse(text: str | None, depth: int) -> tuple[Page, list[tuple[int, int | None, int, int]]]:
    """The page, and (branch, style, content, share) for the tree, hashes and millionths of its text: one for each branch
    above its blocks, and one without a style for each text in its innermost branch.  A branch's style is the sequence of
    its children's marks, its content the text under it."""
    found, has_main = blocks(text)
    page = Page([], [], [t for _, t, _, _ in found], [main for _, _, main, _ in found], [level for _, _, _, level in found], has_main)
    known: dict[str, tuple[list[str], list[int], list[str]]] = {}
    below: dict[int, tuple[list[str], list[str]]] = {}
    for path, t, _, _ in found:
        if path not in known:
            branches = _branches(path, depth)
            known[path] = branches, [_key(x) for x in branches], path.split(">")[1 : depth + 1]
        branches, keys, parts = known[path]
        for i, k in enumerate(keys, 1):
            styles, texts = below.setdefault(k, ([], []))
            styles.append(parts[i] if i < len(parts) else "")
            texts.append(t)
        page.keys.append(keys)
        page.leaves.append(_leaf(branches[-1] if branches else "", t))
    total = sum(map(len, page.texts))
    rows: list[tuple[int, int | None, int, int]] = [(k, _key("|".join(x)), _key("\n".join(t)), 1_000_000 * sum(map(len, t)) // total) for k, (x, t) in below.items()]
    return page, rows + [(keys[-1], None, leaf, 0) for keys, leaf in dict.fromkeys((tuple(k), x) for k, x in zip(page.keys, page.leaves, strict=True)) if keys]


BLOCKS = "array<struct<keys:array<bigint>,leaf:bigint,text:string,main:boolean,level:int>>"
ROWS = "array<struct<branch:bigint,style:bigint,content:bigint,share:bigint>>"


def parsed(pages: DataFrame, p: Params) -> DataFrame:
    """page_id, url, host, has_main, blocks and rows of every page: html is read once."""
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}

    def lists(sizes: list[int], values: pa.Array) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                got = [parse(h.as_py(), p.depth) for h in part["html"]]
                flat = lambda name: [x for page, _ in got for x in getattr(page, name)]
                keys = flat("keys")
                of = pa.StructArray.from_arrays(
                    [lists([len(k) for k in keys], pa.array([x for k in keys for x in k], pa.int64())), pa.array(flat("leaves"), pa.int64()), pa.array(flat("texts"), pa.string()), pa.array(flat("main"), pa.bool_()), pa.array(flat("levels"), pa.int32())],
                    names=["keys", "leaf", "text", "main", "level"],
                )
                rows = list(zip(*(x for _, r in got for x in r), strict=True)) or [[]] * 4
                tree = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in rows], names=["branch", "style", "content", "share"])
                cols = [part["page_id"], part["url"], part["host"], pa.array([page.has_main for page, _ in got], pa.bool_()), lists([len(page.texts) for page, _ in got], of), lists([len(r) for _, r in got], tree)]
                yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "host", "has_main", "blocks", "rows"])

    named = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), "html")
    return named.mapInArrow(run, f"page_id {kinds['page_id']}, url string, host string, has_main boolean, blocks {BLOCKS}, rows {ROWS}")


def importance(pages: DataFrame, p: Params = Params()) -> DataFrame:
    """host, branches, strong: hashes of each site's branches and texts below the threshold, and of those branches that
    stay against the markup; pages: as parsed."""
    seen = pages.filter("host != ''").select("host", F.explode("rows").alias("x")).select("host", "x.*")
    whole = seen.filter("style IS NOT NULL")
    # Counts of each style and content combine before the shuffle; a hot host is one row a distinct content.
    node = ["host", "branch"]
    content = whole.groupBy(*node, "content").agg(F.count("*").alias("c"), F.sum("share").alias("share"))
    content = content.groupBy(*node).agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.log("c")).alias("clogc"), F.sum("share").alias("share"))
    style = whole.groupBy(*node, "style").agg(F.count("*").alias("c")).groupBy(*node).agg(F.sum(F.col("c") * F.log("c")).alias("slogs"))
    content = content.filter(F.col("m") >= p.min_pages)
    log_m = F.log("m")
    own = 1 - F.col("clogc") / (F.col("m") * log_m)
    shown = 1 - F.col("slogs") / (F.col("m") * log_m)
    both = content.join(style, node).withColumn("importance", (1 - p.attenuation) * shown + p.attenuation * own)
    low = F.col("importance") < p.threshold
    strong = (F.col("importance") >= p.strong) & (F.col("share") >= F.col("m") * int(1_000_000 * p.share))
    judged = both.select("host", F.when(low, F.col("branch")).alias("low"), F.when(strong, F.col("branch")).alias("strong"))
    # A text of a judged branch stands on that many pages at least before it can be low, so few come to the join.
    least = p.min_pages ** (1 - p.threshold)
    leaf = seen.filter("style IS NULL").groupBy(*node, "content").agg(F.count("*").alias("c")).filter(F.col("c") > least)
    leaf = leaf.join(content.select(*node, "m"), node).filter(1 - F.log("c") / log_m < p.threshold)
    judged = judged.unionByName(leaf.select("host", F.col("content").alias("low"), F.lit(None).cast("long").alias("strong")))
    judged = judged.filter("low IS NOT NULL OR strong IS NOT NULL").groupBy("host")
    return judged.agg(F.sort_array(F.collect_set("low")).alias("branches"), F.sort_array(F.collect_set("strong")).alias("strong"))


def chosen(page: Page, low: set[int], strong: set[int]) -> str:
    """Blocks of the page joined by empty lines, but for those that the tree finds low; with an article or main element,
    those inside of one and those in a strong branch that holds none.  Named parts stay by strong branches in them."""
    blocks_ = list(zip(page.keys, page.leaves, page.texts, page.main, page.levels, strict=True))
    holds = {k for keys, _, _, main, level in blocks_ if main and not level for k in keys} if strong else set()
    kept = []
    for keys, leaf, t, main, level in blocks_:
        if low and (leaf in low or not low.isdisjoint(keys)):
            continue
        plain = not level and (main or not page.has_main)
        if plain or any(k in strong and k not in holds for k in keys[max(level - 1, 0) :]):
            kept.append(t)
    return "\n\n".join(kept or [t for _, _, t, main, level in blocks_ if main and not level])


def main_text(text: str | None, low: set[int], depth: int, strong: set[int] = frozenset()) -> str:
    return chosen(parse(text, depth)[0], low, strong)


def extract(pages: DataFrame, p: Params = Params()) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, text, n_chars."""
    small_batches(pages.sparkSession)
    whole = materialize(parsed(pages, p), "parsed-pages")
    low = materialize(importance(whole, p), "branches")
    size = low.agg(F.coalesce(F.sum(F.size("branches") + F.size("strong") + 1), F.lit(0))).first()[0]
    rows = whole.drop("rows").join(F.broadcast(low) if size <= p.broadcast_rows else low, "host", "left").select("page_id", "url", "has_main", "blocks", "branches", "strong")
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            ends = b["blocks"].offsets.to_pylist()
            flat = b["blocks"].values
            bounds, values = flat.field("keys").offsets.to_pylist(), flat.field("keys").values.to_pylist()
            cols = [flat.field(c).to_pylist() for c in ("leaf", "text", "main", "level")]
            texts = []
            for i, (has_main, low, strong) in enumerate(zip(b["has_main"].to_pylist(), b["branches"], b["strong"], strict=True)):
                at = range(ends[i], ends[i + 1])
                page = Page([values[bounds[k] : bounds[k + 1]] for k in at], *([c[k] for k in at] for c in cols), has_main)
                texts.append(chosen(page, set(low.as_py() or ()), set(strong.as_py() or ())))
            yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url string, text string, n_chars long")
