"""Main text of web pages: boosted trees over DOM-node features, and decoding over the tree.

Each block element is scored by its subtree's text and link density, the tokens of its tag and attributes and of its
ancestors', its depth, and how it compares with its siblings. Decoding gives every path from the root one run of outer
nodes, then content nodes, then removed ones, choosing the most likely labels of the whole tree; so no removed ancestor has
content below it, and nothing outside the article is kept for one node's sake.

Training pages come from the given pages. Those that name their article (``<article>`` or ``<main>``) label
themselves; each is also laid out anew in several ways, with the same text under other tags and class names
and with menus, notices, forms, asides, adverts and reader comments around and inside the article, so that the
trees can't rely on one layout.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varigrade.llm.boosting import Boosted
from varigrade.llm.common import bounded_sample, slices

#: Pages that the trees are fitted on at most, and layouts made of each.
TRAIN_PAGES, LAYOUTS = 240, 4
# Outside quotes a tag is read up to the next "<" at most, so no reading goes far without taking what it read.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
                  r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^<>\"']++|\"[^\"]*\"|'[^']*')*+)>"
                  r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
#: The rest of a page after its last ">": markup that never ends.
_OPEN_END = re.compile(r"<[!?].*|<[a-zA-Z/][^<>]*\Z", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PIECE = re.compile(r"[a-z]+")
#: Their content is no markup and ends at their closing tag only.
_RAW = frozenset("script style title iframe textarea".split())
#: Nodes whose text is not shown; they end with their parent at the latest.
_UNSHOWN = frozenset("head noscript template select".split())
#: Inside these ``/>`` closes a tag; their text belongs to the block around them.
_FOREIGN = frozenset(("svg", "math"))
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s
    samp small span strike strong sub sup time tt u var""".split())
_CLOSES_P = frozenset("""address article aside blockquote details dialog div dl fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul""".split())
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
         "th": ("td", "th")}
_LISTS = frozenset("ul ol dl table menu".split())
_ENDS = {name: re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I) for name in _RAW}
#: Tags that end an unclosed drawing or formula.
_LEAVES_FOREIGN = _CLOSES_P | frozenset("body dd dt img li span".split())
_COMMENTS, _ARTICLE, _MAIN = r"(?s)<!--.*?-->|<script.*?</script>", r"(?i)<article[\s>]", r"(?i)<main[\s>]"


class Page:
    """Block elements of a page in document order, and its text in pieces that know their block."""

    def __init__(self, source: str | None):
        self.parent, self.tags, self.tokens = [-1], ["#page"], [()]
        self.pieces: list[tuple[int, str]] = []
        self.link_chars, self.inputs = [0], [0]
        self._read(source or "")

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int, int]] = [("#page", 0, 0)]  # (tag, its block, nearest place that holds no inline tag)
        opened: Counter[str] = Counter()  # tags on the stack, so that a stray one is known without looking through it
        links, hidden, foreign, at, end = 0, 0, 0, 0, len(source)
        closed_until = source.rfind(">") + 1

        def drop(depth: int) -> None:
            for gone, _, _ in stack[depth:]:
                opened[gone] -= 1
            del stack[depth:]

        while at < end:
            tag = _TAG.search(source, at) if at < closed_until else None
            if tag is None or tag.start() >= closed_until:
                tag = _OPEN_END.search(source, max(at, closed_until))
                if tag:
                    end = tag.start()
                    tag = None
            stop = tag.start() if tag else end
            if stop > at and not hidden:
                text = source[at:stop]
                if "&" in text:
                    text = html.unescape(text)
                block = stack[-1][1]
                self.pieces.append((block, text))
                if links:
                    self.link_chars[block] += len(text.strip())
            if not tag:
                break
            at = tag.end()
            name = tag[2] or tag[5]
            if not name:
                continue
            name, closing = name.lower(), bool(tag[1] or tag[4])
            if closing:
                if not opened[name]:
                    continue
                depth = next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name)
                for gone, block, _ in stack[depth:]:
                    links -= gone == "a"
                    hidden -= gone in _UNSHOWN
                    foreign -= gone in _FOREIGN
                    if gone not in _INLINE and block != stack[depth - 1][1]:
                        self.pieces.append((self.parent[block], " "))
                drop(depth)
                continue
            if name in _VOID:
                if name in ("br", "hr"):
                    self.pieces.append((stack[-1][1], " "))
                elif name == "input":
                    self.inputs[stack[-1][1]] += 1
                continue
            if foreign and name in _LEAVES_FOREIGN:
                depth = next((k for k, (t, _, _) in enumerate(stack) if t in _FOREIGN), len(stack))
                links -= sum(t == "a" for t, _, _ in stack[depth:])
                hidden -= sum(t in _UNSHOWN for t, _, _ in stack[depth:])
                foreign = 0
                drop(depth)
            if (foreign or name in _FOREIGN) and tag[0].endswith("/>"):
                continue
            if name in _RAW:
                found = _ENDS[name].search(source, at)
                at = found.end() if found else end
                continue
            if name in _CLOSES_P:
                depth = stack[-1][2]
                if depth and stack[depth][0] == "p":
                    links -= sum(t == "a" for t, _, _ in stack[depth:])
                    self.pieces.append((self.parent[stack[depth][1]], " "))
                    drop(depth)
            elif name in _SAME and any(opened[t] for t in _SAME[name]):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in _LISTS:
                        break
                    if stack[k][0] in _SAME[name]:
                        links -= sum(t == "a" for t, _, _ in stack[k:])
                        hidden -= sum(t in _UNSHOWN for t, _, _ in stack[k:])
                        drop(k)
                        break
            elif name == "body" and hidden:
                shown = [s for s in stack if s[0] not in _UNSHOWN]
                drop(0)
                for tag_name, block, _ in shown:
                    stack.append((tag_name, block, stack[-1][2] if tag_name in _INLINE else len(stack)))
                    opened[tag_name] += 1
                hidden = 0
            block = stack[-1][1]
            if name in _INLINE or foreign or name in _FOREIGN:
                links += name == "a"
                hidden += name in _UNSHOWN
                foreign += name in _FOREIGN
            else:
                hidden += name in _UNSHOWN
                self.pieces.append((block, " "))
                self.parent.append(block)
                block = len(self.tags)
                self.tags.append(name)
                self.tokens.append(_tokens(name, tag[3] or tag[6] or ""))
                self.link_chars.append(0)
                self.inputs.append(0)
            stack.append((name, block, stack[-1][2] if name in _INLINE else len(stack)))
            opened[name] += 1

    def text(self, kept: list[bool] | np.ndarray) -> str:
        """The text of kept blocks in page order, white space as one space."""
        parts, last = [], True
        for block, text in self.pieces:
            if kept[block]:
                parts.append(text)
            elif last:
                parts.append(" ")
            last = kept[block]
        return " ".join("".join(parts).split())


def _tokens(name: str, attributes: str) -> tuple[str, ...]:
    found = ["<" + name]
    if attributes:
        for kind, a, b, c in _ATTRIBUTE.findall(attributes):
            found += _PIECE.findall((a or b or c).lower())
            if kind.lower() == "role":
                found[-1:] = ["role=" + found[-1]] if len(found) > 1 else []
    return tuple(found)


def node_features(page: Page, odds: dict[str, float]) -> np.ndarray:
    """One row per block."""
    count = len(page.tags)
    chars, words, stops, first = [0] * count, [0] * count, [0] * count, [-1] * count
    at = 0
    for block, text in page.pieces:
        bare = text.strip()
        if bare:
            if first[block] < 0:
                first[block] = at
            chars[block] += len(bare)
            words[block] += bare.count(" ") + 1
            stops[block] += bare.count(".") + bare.count(",")
            at += len(bare)
    own = list(chars)
    links, inputs = list(page.link_chars), list(page.inputs)
    below, paragraphs, kids, longest = [0] * count, [0] * count, [0] * count, list(chars)
    parent = page.parent
    for k in range(count - 1, 0, -1):
        up = parent[k]
        chars[up] += chars[k]
        words[up] += words[k]
        stops[up] += stops[k]
        links[up] += links[k]
        inputs[up] += inputs[k] + (page.tags[k] in ("form", "button"))
        below[up] += below[k] + 1
        paragraphs[up] += paragraphs[k] + (page.tags[k] == "p")
        kids[up] += 1
        longest[up] = max(longest[up], longest[k])
        if first[k] >= 0 and (first[up] < 0 or first[k] < first[up]):
            first[up] = first[k]
    whole = max(1, chars[0])
    density = [chars[k] / (below[k] + 1) for k in range(count)]
    rows = np.zeros((count, 26))
    order, low, high, depth, same = [0] * count, [0.0] * count, [0.0] * count, [0] * count, Counter()
    seen: Counter = Counter()
    for k in range(1, count):
        same[parent[k], page.tags[k]] += 1
    previous: dict[int, int] = {}
    for k in range(count):
        up = max(parent[k], 0)
        values = [odds.get(t, 0.0) for t in page.tokens[k]] or [0.0]
        least, most = min(values), max(values)
        if k:
            depth[k] = depth[up] + 1
            order[k] = seen[up]
            seen[up] += 1
        low[k], high[k] = min(low[up], least), max(high[up], most)
        before = previous.get(up, 0) if k else 0
        previous[up] = k
        n = max(1, chars[k])
        rows[k] = (
            sum(values) / len(values), least, most, low[up], high[up], values[0], depth[k], chars[k], links[k] / n, below[k],
            density[k], chars[k] / whole, paragraphs[k], words[k] / max(1, below[k] + 1), stops[k] / n, longest[k],
            order[k] / max(1, kids[up] - 1), kids[up], same[up, page.tags[k]] / max(1, kids[up]), density[up],
            density[k] / max(1.0, density[up]), first[k] / whole if first[k] >= 0 else 1.0, inputs[k],
            density[before], own[k] / n, chars[k] / max(1, chars[up]))
    return rows


def decode(parent: list[int], scores: np.ndarray) -> np.ndarray:
    """True for content nodes in the most likely labelling whose paths read outer, content, removed."""
    count = len(parent)
    yes, no = -np.logaddexp(0, -scores), -np.logaddexp(0, scores)
    removed, content, outer = no.copy(), yes.copy(), no.copy()
    for k in range(count - 1, 0, -1):
        up = parent[k]
        removed[up] += removed[k]
        content[up] += max(content[k], removed[k])
        outer[up] += max(outer[k], content[k])
    state = np.zeros(count, np.int8)  # 0 outer, 1 content, 2 removed
    state[0] = content[0] > outer[0]
    for k in range(1, count):
        above = state[parent[k]]
        state[k] = above and (2 if above == 2 or removed[k] > content[k] else 1) or int(
            not above and content[k] > outer[k])
    return state == 1


class Extractor:
    def __init__(self, trees: Boosted | None, odds: dict[str, float]):
        self.trees, self.odds = trees, odds

    def extract(self, sources: list[str | None]) -> list[str]:
        pages = [Page(s) for s in sources]
        if self.trees is None:
            return [p.text([True] * len(p.tags)) for p in pages]
        rows = [node_features(p, self.odds) for p in pages]
        scores = self.trees.scores(np.concatenate(rows)) if rows else np.zeros(0)
        out, at = [], 0
        for page, some in zip(pages, rows):
            out.append(page.text(decode(page.parent, scores[at: at + len(some)])))
            at += len(some)
        return out


def own_labels(page: Page) -> np.ndarray | None:
    """Content flags of a page that names its one article; None for others."""
    roots = [k for k, t in enumerate(page.tags) if t == "article"] or [
        k for k, t in enumerate(page.tags) if t == "main"]
    if len(roots) != 1:
        return None
    inside = np.zeros(len(page.tags), bool)
    for k in range(roots[0], len(page.tags)):
        inside[k] = k == roots[0] or inside[page.parent[k]]
    return inside


#: Names that layouts give to their parts; class names in common use, none of them needed for a result.
_CONTENT_NAMES = "content article post entry story main text body page single prose".split()
_OUTSIDE = {
    "nav": "nav menu navbar breadcrumb navigation toc topbar links".split(),
    "header": "header masthead banner top branding logo".split(),
    "footer": "footer foot bottom copyright legal credits".split(),
    "aside": "sidebar aside widget related recommended popular rail".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo banner".split(),
    "notice": "cookie notice consent alert gdpr message popup modal newsletter".split(),
    "form": "form search subscribe login signup contact".split(),
    "comments": "comments comment replies discussion responses disqus reply thread".split(),
    "share": "share social tags meta byline author toolbar pagination".split(),
}
_OWN_TAG = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}


def _layout(page: Page, inside: np.ndarray, words: list[str], rng: random.Random) -> str:
    """The page's article in a new layout; ``data-main`` marks true content, ``data-out`` what isn't."""
    blocks: dict[int, list[str]] = {}
    for block, text in page.pieces:
        if inside[block] and text.strip():
            blocks.setdefault(block, []).append(text)
    paragraphs = [(page.tags[b], " ".join(" ".join(t).split())) for b, t in sorted(blocks.items())]

    def phrase(low: int, high: int) -> str:
        at, size = rng.randrange(max(1, len(words))), rng.randint(low, high)
        return html.escape(" ".join(words[at: at + size]) or "more")

    def name(kind: list[str]) -> str:
        if rng.random() < 0.25:
            return f"{rng.choice('abcdefgh')}{rng.randrange(99)}"
        return rng.choice(["", "site-", "page-", "js-", "c-"]) + rng.choice(kind) + rng.choice(["", "-wrap", "-box", "_1"])

    def opening(tag: str, kind: list[str], mark: str) -> str:
        attribute = rng.choice(["class", "class", "class", "id"])
        given = f' {attribute}="{name(kind)}"' if rng.random() < 0.9 or tag == "div" else ""
        return f"<{tag}{given} data-{mark}>"

    def outside(kind: str) -> str:
        tag = _OWN_TAG.get(kind, "div") if rng.random() < 0.5 else "section" if rng.random() < 0.2 else "div"
        begin = opening(tag, _OUTSIDE[kind], "out")
        if kind in ("nav", "share") or kind in ("footer", "aside", "header") and rng.random() < 0.5:
            inner = "<ul>" + "".join(f'<li><a href="/x">{phrase(1, 3)}</a></li>' for _ in range(rng.randint(2, 9))) + "</ul>"
        elif kind == "form":
            tag = "form" if rng.random() < 0.8 else tag
            begin = opening(tag, _OUTSIDE[kind], "out")
            inner = f"<label>{phrase(1, 4)}</label><input name=q><button>{phrase(1, 2)}</button><p>{phrase(2, 15)}</p>"
        elif kind == "comments":
            inner = f"<h3>{phrase(1, 2)}</h3>" + "".join(
                f'<div class="{name(_OUTSIDE[kind])}">' + f"<p>{phrase(4, 60)}</p>" * 1 + "</div>"
                if rng.random() < 0.6 else f"<p>{phrase(4, 60)}</p>" for _ in range(rng.randint(1, 6)))
        else:
            inner = rng.choice(["<p>{}</p>", "{}", "<h4>{}</h4><p>{}</p>", "<div>{}</div>"]).format(phrase(2, 30), phrase(3, 40))
        return f"{begin}{inner}</{tag}>"

    inner = []
    for k, (tag, text) in enumerate(paragraphs):
        text = html.escape(text)
        tag = tag if tag in ("h1", "h2", "h3", "li", "pre", "blockquote") else "p"
        if tag == "p" and rng.random() < 0.08:
            half = len(text.split()) // 2
            inner.append("<ul>" + "".join(f"<li>{' '.join(part)}</li>" for part in (text.split()[:half], text.split()[half:])
                                          if part) + "</ul>")
        elif tag == "p" and rng.random() < 0.15:
            inner.append(rng.choice(["<h2>{}</h2>", "<blockquote><p>{}</p></blockquote>", "<div>{}</div>",
                                     "<p><a href='/y'>{}</a></p>", "<table><tr><td>{}</td></tr></table>"]).format(text))
        else:
            inner.append(f"<{tag}>{text}</{tag}>")
        if rng.random() < 0.12:
            inner.append(outside(rng.choice(["ad", "aside", "share", "form", "notice"])))
    if rng.random() < 0.4:
        inner.append(outside(rng.choice(["comments", "share", "aside"])))
    tag = rng.choice(["article", "main", "div", "div", "div", "section"])
    article = opening(tag, _CONTENT_NAMES, "main") + "".join(inner) + f"</{tag}>"
    before = [outside(k) for k in rng.sample(["header", "nav", "notice", "ad", "form"], rng.randint(0, 4))]
    after = [outside(k) for k in rng.sample(["aside", "comments", "ad", "footer", "share", "notice"], rng.randint(0, 4))]
    if rng.random() < 0.5:
        wrapped = f"<div class='{name(['wrapper', 'container', 'layout', 'row', 'page'])}'>"
        cut = rng.randint(0, len(after))
        article = wrapped + article + "".join(after[:cut]) + "</div>"
        after = after[cut:]
    return "<html><body>" + "".join(before) + article + "".join(after) + "</body></html>"


_MARK = re.compile(r" data-(main|out)>")


def _marked_labels(source: str) -> tuple[Page, np.ndarray]:
    """A laid-out page without its marks, and its content flags."""
    marks: list[str | None] = []
    for tag in _TAG.finditer(source):
        name = (tag[2] or tag[5] or "").lower()
        if name and not (tag[1] or tag[4]) and name not in _VOID | _RAW | _INLINE:
            found = _MARK.search(tag[0])
            marks.append(found[1] if found else None)
    page = Page(_MARK.sub(">", source))
    inside = np.zeros(len(page.tags), bool)
    for k in range(1, len(page.tags)):
        mark = marks[k - 1]
        inside[k] = mark == "main" or mark is None and inside[page.parent[k]]
    return page, inside


def fit(sources: list[str], layouts: int = LAYOUTS, seed: int = 23) -> Extractor:
    """Token odds and trees from pages that name their article; without any such page all text is kept."""
    rng = random.Random(seed)
    made: list[tuple[Page, np.ndarray]] = []
    for source in sources:
        page = Page(source)
        inside = own_labels(page)
        if inside is None or not inside.any():
            continue
        made.append((page, inside))
        words = page.text(np.ones(len(page.tags), bool)).split()
        made += [_marked_labels(_layout(page, inside, words, rng)) for _ in range(layouts)]
    if not made:
        return Extractor(None, {})
    yes, no = Counter(), Counter()
    for page, inside in made:
        for tokens, flag in zip(page.tokens, inside):
            (yes if flag else no).update(set(tokens))
    a, b = sum(yes.values()), sum(no.values())
    odds = {t: float(np.log((yes[t] + 1) / (no[t] + 1) * (b + 2) / (a + 2))) for t in yes.keys() | no.keys()
            if yes[t] + no[t] >= 5}
    rows = np.concatenate([node_features(p, odds) for p, _ in made])
    labels = np.concatenate([flags for _, flags in made]).astype(float)
    return Extractor(Boosted().fit(rows, labels), odds)


def train(pages: DataFrame, key: str = "page_id", source: str = "html", rows: int = TRAIN_PAGES) -> Extractor:
    """Fit on at most ``rows`` pages, all of which name their article."""
    bare = F.regexp_replace(F.col(source).cast("string"), _COMMENTS, "")
    articles, mains = F.regexp_count(bare, F.lit(_ARTICLE)), F.regexp_count(bare, F.lit(_MAIN))
    named = pages.filter(F.col(key).isNotNull() & ((articles == 1) | (articles == 0) & (mains == 1)))
    ids = bounded_sample(named.select(key), key, rows).select(
        F.col(key).alias("_chosen")).distinct()
    chosen = pages.join(F.broadcast(ids), pages[key] == F.col("_chosen")).select(key, source).toArrow()
    found = sorted(zip(chosen.column(0).to_pylist(), chosen.column(1).to_pylist()))
    return fit([s for _, s in found if s is not None])


def extract_main_text(pages: DataFrame, extractor: Extractor, key: str = "page_id", url: str = "url",
                      source: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row; null or empty html gives an empty text. Repeated rows each give a row."""
    shared = pages.sparkSession.sparkContext.broadcast(extractor)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
        for batch in slices(batches, 128):
            texts = shared.value.extract(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    return pages.select(F.col(key).cast("long"), F.col(url).cast("string"), F.col(source).cast("string")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
