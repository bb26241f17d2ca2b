"""Main text of web pages: a recurrent labeller reads a page's blocks in order and decides each in the light of all.

A block is the text between two block-level borders. It is described by a
vector of its tag path (tags, classes, ids of all ancestors) and one of its
words, both hashed and learnt; a bidirectional LSTM in numpy runs over the
page's sequence. Labels for training come from pages whose markup names its
parts plainly, in the variants that page templates use for the same parts, so
that the labeller also knows pages that say it otherwise.
"""

from __future__ import annotations

import html
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namefold.llm.common import text_groups, whole_text

# Fixed values of the markup language.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg iframe".split())
INLINE = frozenset("a abbr b bdi bdo br cite code data dfn em font i img kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
# Start tags that cannot stand in an svg: they end one left open, unless one of its parts that hold html is open.
BREAKS = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
HOLDS_HTML = frozenset("foreignobject desc title".split())
SPACE = re.compile(r"[ \t\n\r\f\v ]+")
_COMMENT_END = "-->"
_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_EVENT = re.compile(r"[>\"']")
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_NAME_PARTS = re.compile(r"[a-z]+")
_WORD = re.compile(r"\w+")
_GAP = re.compile(r"\W")

PATH_DIMS, WORD_DIMS, PATH_SIZE, WORD_SIZE, HIDDEN = 2048, 4096, 16, 8, 16
#: A text's words are found, and the vectors of all words added up, in pieces of about so many characters or words.
PIECE = 1 << 16
#: Bounds of the training sample: at most so many pages, in so many variants each.
SAMPLE_PAGES, VARIANTS = 150, 10
#: Shares of variants' names that are replaced by unknown ones, and of other parts marked the plain way.
STRANGE, PLAIN_WRAP = 0.2, 0.5
EPOCHS, BATCH, RATE, SEED = 10, 20, 0.01, 5
THRESHOLD = 0.5


class Path:
    """An open element and those around it, as a link to its parent; the hashed marks of all of them are shared where nothing is added."""

    __slots__ = ("parent", "marks", "ids")

    def __init__(self, parent: Path | None, marks: tuple[str, ...]) -> None:
        self.parent, self.marks = parent, marks
        old = parent.ids if parent else ()
        new = mark_ids(marks)
        self.ids = old if new.issubset(old) else tuple(sorted(new.union(old)))

    def whole(self) -> tuple[str, ...]:
        chain, at = [], self
        while at is not None:
            chain.append(at.marks)
            at = at.parent
        return tuple(m for marks in reversed(chain) for m in marks)


@dataclass(slots=True)
class Block:
    at: Path | None
    text: str

    @property
    def path(self) -> tuple[str, ...]:
        return self.at.whole() if self.at else ()


@dataclass(slots=True)
class Tag:
    start: int
    end: int
    closing: bool
    name: str
    attributes: str


class Tags:
    """Reads a page's tags forward in one pass; comments and declarations come as tags without a name.

    A tag ends at the first > outside quotes. One that never ends is text. What
    was found to have no end is remembered, so that broken pages cost no more
    than whole ones: scans that meet at a quote or > go on alike from there.
    """

    def __init__(self, page: str) -> None:
        self.page, self.endless, self.event = page, set(), (0, -1)

    def first_event(self, at: int) -> int:
        """The first quote or > at or after ``at``; asked in rising order."""
        asked, found = self.event
        if not asked <= at <= found:
            hit = _EVENT.search(self.page, at)
            found = hit.start() if hit else len(self.page)
            self.event = (at, found)
        return found

    def tag_end(self, at: int) -> int:
        """The place of the > that ends a tag whose name ends at ``at``, or -1."""
        page, passed = self.page, []
        at = self.first_event(at)
        while at < len(page) and at not in self.endless:
            if page[at] == ">":
                return at
            passed.append(at)
            close = page.find(page[at], at + 1)
            if close < 0:
                break
            hit = _EVENT.search(page, close + 1)
            at = hit.start() if hit else len(page)
        self.endless.update(passed)
        return -1

    def next(self, at: int) -> Tag | None:
        page = self.page
        while (at := page.find("<", at)) >= 0:
            if page.startswith("<!--", at):
                end = page.find(_COMMENT_END, at + 4)
                return Tag(at, len(page) if end < 0 else end + 3, False, "", "")
            if page.startswith(("<!", "<?"), at):
                end = page.find(">", at)
                return Tag(at, len(page) if end < 0 else end + 1, False, "", "")
            named = _NAME.match(page, at)
            if named:
                end = self.tag_end(named.end())
                if end >= 0:
                    return Tag(at, end + 1, named[1] == "/", named[2].lower(), page[named.end() : end])
            at += 1
        return None


def after_svg(tags: Tags, at: int) -> int:
    """Where the page goes on after the svg whose start tag ends at ``at``; svgs inside it are counted."""
    depth, html_parts = 1, 0
    while (tag := tags.next(at)) is not None:
        at = tag.end
        whole = tag.attributes.endswith("/")
        if tag.name == "svg":
            if tag.closing:
                depth -= 1
                if depth == 0:
                    return tag.end
            elif not whole:
                depth += 1
        elif tag.name in HOLDS_HTML:
            html_parts = max(0, html_parts - 1) if tag.closing else html_parts + (not whole)
        elif tag.name in BREAKS and not tag.closing and not html_parts:
            return tag.start
    return len(tags.page)


def after_raw(page: str, name: str, at: int) -> int:
    """Where the page goes on after a raw element's text that begins at ``at``."""
    found = re.compile(rf"</{name}\b", re.I).search(page, at)
    end = page.find(">", found.end()) if found else -1
    return len(page) if end < 0 else end + 1


def blocks(page: str) -> list[Block]:
    """The page's blocks with text, in order. Broken markup is taken as it comes: open tags end with their parent, stray ends are ignored."""
    out: list[Block] = []
    stack: list[tuple[str, Path]] = []
    opened: Counter[str] = Counter()
    parts: list[str] = []
    tags, at = Tags(page), 0

    def close_block() -> None:
        if parts:
            text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                out.append(Block(stack[-1][1] if stack else None, text))

    def leave() -> str:
        name = stack.pop()[0]
        opened[name] -= 1
        return name

    while at < len(page):
        tag = tags.next(at)
        if tag is None:
            # A tag cut off by the end of the page is markup, not text.
            tail = page[at:]
            cut = tail.rfind("<")
            if cut >= 0 and re.match(r"</?[a-zA-Z!?]", tail[cut:]):
                tail = tail[:cut]
            parts.append(tail)
            break
        if tag.start > at:
            parts.append(page[at : tag.start])
        at, name = tag.end, tag.name
        if not name:
            continue
        if name not in INLINE:
            close_block()
        elif name == "br":
            parts.append(" ")
        if tag.closing:
            if opened[name] and name not in VOID:
                while leave() != name:
                    pass
        elif name == "svg":
            # Closed in itself it holds nothing; elsewhere in RAW the slash means nothing.
            if not tag.attributes.endswith("/"):
                at = after_svg(tags, at)
        elif name in RAW:
            at = after_raw(page, name, at)
        elif name not in VOID and not tag.attributes.endswith("/"):
            if name in ("p", "li", "td", "th", "tr", "dt", "dd", "option"):
                # These end where the next of their kind begins beside them.
                if stack and stack[-1][0] == name:
                    leave()
            named = [part for value in _NAMED.findall(tag.attributes) for part in _NAME_PARTS.findall("".join(value).lower())]
            stack.append((name, Path(stack[-1][1] if stack else None, (name, *(f".{part}" for part in named)))))
            opened[name] += 1
    close_block()
    return out


# How templates mark the parts of a page; the first of each list is the plain way.
CONTENT_WRAPS = (("article",), ("main",), ("div", ".content"), ("div", ".article", ".body"), ("div", ".post", ".content"), ("section", ".entry"), ("div", ".main", ".text"), ("main", "article"), ("div", ".story"), ("div", ".post"), ("div",), ("section",))
OTHER_WRAPS = {
    "menu": (("nav",), ("div", ".menu"), ("ul", ".nav"), ("div", ".navbar"), ("div", ".breadcrumb"), ("nav", ".navigation"), ("div", ".links")),
    "header": (("header",), ("div", ".header"), ("div", ".masthead"), ("div", ".banner"), ("div", ".site", ".header")),
    "footer": (("footer",), ("div", ".footer"), ("div", ".copyright"), ("div", ".site", ".footer"), ("section", ".bottom")),
    "side": (("aside",), ("div", ".sidebar"), ("div", ".widget"), ("div", ".related"), ("section", ".recommended"), ("aside", ".side")),
    "notice": (("div", ".cookie"), ("div", ".notice"), ("div", ".consent"), ("div", ".alert"), ("div", ".popup"), ("div", ".gdpr", ".banner"), ("div", ".newsletter"), ("dialog",)),
    "advert": (("div", ".ad"), ("div", ".ads"), ("div", ".advert"), ("div", ".sponsored"), ("div", ".promo"), ("ins", ".adsbygoogle"), ("section", ".sponsor")),
    "form": (("form",), ("form", ".search"), ("div", ".subscribe"), ("form", ".login"), ("div", ".signup"), ("fieldset",)),
    "comment": (("section", ".comments"), ("div", ".comment"), ("div", ".comment", ".list"), ("div", ".replies"), ("ol", ".commentlist"), ("div", ".discussion"), ("div", ".disqus", ".thread")),
}
#: What content and menus are made of.
CONTENT_TAGS = (("p",), ("ul", "li"), ("ol", "li"), ("blockquote",), ("blockquote", "p"), ("table", "tr", "td"), ("table", "tr", "th"), ("pre",), ("dl", "dd"), ("dl", "dt"), ("h2",), ("h3",), ("h4",), ("div",), ("figure", "figcaption"), ("section", "p"), ("div", "p"))
MENU_TAGS = (("ul", "li", "a"), ("ul", "li"), ("ol", "li", "a"), ("a",), ("div", "a"), ("p", "a"), ("span",), ("div",), ("p",))
OTHER_TAGS = (("p",), ("div",), ("ul", "li"), ("h3",), ("h1",), ("span",), ("small",), ("div", "p"), ("a",), ("ul", "li", "p"), ())
_PLAIN = {"nav": "menu", "header": "header", "footer": "footer", "aside": "side", "form": "form", ".ad": "advert", ".ads": "advert", ".comments": "comment", ".comment": "comment", ".cookie": "notice", ".notice": "notice", ".sidebar": "side"}


def plain_label(path: tuple[str, ...]) -> str | None:
    """What plain markup says of a block: ``content``, a kind of other part, or None where it does not say."""
    said = None
    for mark in path:
        if mark in ("article", "main"):
            said = "content"
        elif mark in _PLAIN:
            said = _PLAIN[mark]
    return said


def variant(page: list[tuple[Block, str]], draw: np.random.Generator) -> list[tuple[tuple[str, ...], str, int]]:
    """The same page as another template might mark it: (path, text, label).

    Blocks of all parts get other tags of their own, content also lists, quotes,
    tables and code, some of it short; other parts also get pieces of text from
    content, and parts the page lacks are added. So neither a block's own tag
    nor its length tells what it is.
    """
    wraps = {kind: some[0 if draw.random() < PLAIN_WRAP else draw.integers(len(some))] for kind, some in OTHER_WRAPS.items()}
    content = CONTENT_WRAPS[draw.integers(len(CONTENT_WRAPS))]
    outer = (("div", ".wrapper"), (), ("div", ".page"), ("div", ".container"), ())[draw.integers(5)]

    def inner(path: tuple[str, ...], kind: str) -> tuple[str, ...]:
        marks = list(path)
        for k in range(len(marks) - 1, -1, -1):
            if (marks[k] in ("article", "main") if kind == "content" else _PLAIN.get(marks[k]) == kind):
                return tuple(marks[k + 1 :])
        return ()

    retag, shorten = draw.random() * (draw.random() < 0.8), draw.random() * (draw.random() < 0.5)
    own_menu = MENU_TAGS[draw.integers(len(MENU_TAGS))]
    out = []
    for block, kind in page:
        within, text = inner(block.path, kind), block.text
        if draw.random() < retag:
            some = CONTENT_TAGS if kind == "content" else OTHER_TAGS
            within = own_menu if kind == "menu" else some[draw.integers(len(some))]
        if kind == "content" and draw.random() < shorten:
            words = text.split()
            first = int(draw.integers(len(words)))
            text = " ".join(words[first : first + int(draw.integers(1, 12))])
        out.append((("html", "body", *outer, *(content if kind == "content" else wraps[kind]), *within), text, int(kind == "content")))
    # Of content some pages have little, some none of the usual order.
    if draw.random() < 0.3:
        keep = draw.random()
        out = [row for row in out if not row[2] or draw.random() < keep]
    texts = [block.text for block, _ in page]
    for kind, tags in (("header", ("h1", "p", "a")), ("side", ("li", "p", "h3")), ("notice", ("p", "span", "button")), ("form", ("label", "button", "p")), ("comment", ("p", "li", "div")), ("advert", ("p", "a", "span"))):
        if draw.random() < 0.5:
            choice = [(tag,) for tag in tags] + list(OTHER_TAGS)
            words = texts[draw.integers(len(texts))].split()
            rows = [
                (("html", "body", *outer, *(content if draw.random() < 0.3 else ()), *wraps[kind], *choice[draw.integers(len(choice))]), " ".join(words[at : at + int(draw.integers(1, 40))]) or "x", 0)
                for at in draw.integers(0, max(1, len(words)), int(draw.integers(1, 5)))
            ]
            # Before or after the content as it now stands, or at the page's end; adverts also amid it.
            middle = [k for k, row in enumerate(out) if row[2]] or [0]
            places = {"header": [0], "notice": [0, len(out)], "comment": [middle[-1] + 1, len(out)], "advert": [middle[0], middle[-1] + 1, *middle]}
            places = places.get(kind, [middle[0], middle[-1] + 1, len(out)])
            at = places[draw.integers(len(places))]
            out[at:at] = rows
    # Names never seen elsewhere: what they stand for has to follow from the text and its neighbours.
    strange = {m: f".{draw.integers(1 << 30):x}" for m in {m for path, _, _ in out for m in path if m[0] == "."} if draw.random() < STRANGE}
    return [(tuple(strange.get(m, m) for m in path), text, y) for path, text, y in out]


@lru_cache(maxsize=20_000)
def mark_ids(marks: tuple[str, ...]) -> frozenset[int]:
    """The tags html and body say nothing and may be left out of a page, so they are dropped wherever they stand; their classes stay."""
    return frozenset(zlib.crc32(m.encode("utf-8", "replace")) % PATH_DIMS for m in marks if m not in ("html", "body"))


def path_marks(path: tuple[str, ...]) -> list[int]:
    return sorted(mark_ids(path) or {0})


@lru_cache(maxsize=1 << 16)
def word_id(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % WORD_DIMS


def word_counts(text: str) -> Counter[int]:
    """How often each hashed word stands in the text: every word counts. A piece ends between two words."""
    text, counts, at = text.lower(), Counter(), 0
    while at < len(text):
        gap = _GAP.search(text, at + PIECE)
        end = gap.start() if gap else len(text)
        counts.update(map(word_id, _WORD.findall(text, at, end)))
        at = end
    return counts


def described(marks: Sequence[int], in_link: bool, text: str) -> tuple[Sequence[int], array, list[float], array]:
    """Hashed marks of the path, hashed words, a few plain measures, and each hashed word's share of all words."""
    counts = word_counts(text)
    n = counts.total()
    return marks, array("H", counts), [min(n, 200) / 100, float(text[-1:] in ".!?\"”"), float(in_link)], array("d", [k / n for k in counts.values()])


def features(path: tuple[str, ...], text: str) -> tuple[Sequence[int], array, list[float], array]:
    return described(path_marks(path), path[-1:] == ("a",), text)


def block_features(block: Block) -> tuple[Sequence[int], array, list[float], array]:
    """What `features` says, without the whole path written out for every block of a deep page."""
    at = block.at
    return described(at.ids or (0,) if at else (0,), at is not None and at.marks[-1] == "a", block.text)


class Labeller:
    """Embedding bags, an LSTM in each direction, one probability per block. Gates in the order input, forget, output, candidate."""

    def __init__(self) -> None:
        draw = np.random.default_rng(SEED)
        width = PATH_SIZE + WORD_SIZE + 3
        self.params = {"path": draw.normal(0, 0.3, (PATH_DIMS, PATH_SIZE)), "word": draw.normal(0, 0.05, (WORD_DIMS, WORD_SIZE)), "out": draw.normal(0, 0.1, 2 * HIDDEN), "base": np.zeros(1)}
        for side in ("f", "b"):
            self.params[f"w{side}"] = draw.normal(0, (width + HIDDEN) ** -0.5, (width + HIDDEN, 4 * HIDDEN))
            self.params[f"c{side}"] = np.concatenate((np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)))

    def inputs(self, pages: list[list[tuple]]) -> tuple[np.ndarray, np.ndarray, dict]:
        """Padded (step, page, width) inputs and the mask of real blocks."""
        lengths = np.array([len(p) for p in pages])
        flat = [b for p in pages for b in p]
        bags = {}
        parts = []
        for k, name, size in ((0, "path", PATH_SIZE), (1, "word", WORD_SIZE)):
            counts = np.array([len(b[k]) for b in flat])
            ids = np.fromiter((i for b in flat for i in b[k]), np.int64, int(counts.sum()))
            owner = np.repeat(np.arange(len(flat)), counts)
            weight = np.fromiter((i for b in flat for i in b[3]), np.float64, len(ids)) if name == "word" else np.ones(len(ids))
            total = np.zeros((len(flat), size))
            ends = np.cumsum(counts)
            # Pieces of whole blocks: a block's sum does not depend on its neighbours, and a block has at most WORD_DIMS ids.
            first = 0
            while first < len(flat):
                base = int(ends[first] - counts[first])
                last = max(first + 1, int(np.searchsorted(ends, base + PIECE, "right")))
                held = first + np.flatnonzero(counts[first:last])
                if len(held):
                    some = slice(base, int(ends[last - 1]))
                    total[held] = np.add.reduceat(self.params[name][ids[some]] * weight[some, None], ends[held] - counts[held] - base)
                first = last
            bags[name] = (ids, owner, weight)
            parts.append(total)
        parts.append(np.array([b[2] for b in flat], np.float64).reshape(-1, 3))
        steps = int(lengths.max())
        mask = np.arange(steps)[:, None] < lengths
        x = np.zeros((steps, len(pages), sum(p.shape[1] for p in parts)))
        page_of, step_of = np.repeat(np.arange(len(pages)), lengths), np.concatenate([np.arange(n) for n in lengths])
        x[step_of, page_of] = np.concatenate(parts, axis=1)
        return x, mask, {"bags": bags, "step": step_of, "page": page_of}

    def run(self, x: np.ndarray, mask: np.ndarray, side: str, keep: bool) -> tuple[np.ndarray, list]:
        steps, n, _ = x.shape
        h, c = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
        out, tape = np.zeros((steps, n, HIDDEN)), []
        w, bias = self.params[f"w{side}"], self.params[f"c{side}"]
        given = x @ w[: x.shape[2]] + bias
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            live = mask[t][:, None]
            gates = given[t] + h @ w[x.shape[2] :]
            sig = 1 / (1 + np.exp(-gates[:, : 3 * HIDDEN]))
            i, f, o = sig[:, :HIDDEN], sig[:, HIDDEN : 2 * HIDDEN], sig[:, 2 * HIDDEN :]
            g = np.tanh(gates[:, 3 * HIDDEN :])
            c_new = f * c + i * g
            tanh_c = np.tanh(c_new)
            if keep:
                tape.append((t, h, c, i, f, o, g, tanh_c))
            h, c = np.where(live, o * tanh_c, h), np.where(live, c_new, c)
            out[t] = h
        return out, tape

    def probabilities(self, pages: list[list[tuple]]) -> list[np.ndarray]:
        x, mask, where = self.inputs(pages)
        both = np.concatenate((self.run(x, mask, "f", False)[0], self.run(x, mask, "b", False)[0]), axis=2)
        p = 1 / (1 + np.exp(-(both @ self.params["out"] + self.params["base"][0])))
        return [p[: len(page), k] for k, page in enumerate(pages)]

    def gradients(self, pages: list[list[tuple]], labels: list[list[int]]) -> dict[str, np.ndarray]:
        x, mask, where = self.inputs(pages)
        runs = {side: self.run(x, mask, side, True) for side in "fb"}
        both = np.concatenate((runs["f"][0], runs["b"][0]), axis=2)
        y = np.zeros(mask.shape)
        y[where["step"], where["page"]] = np.concatenate(labels)
        d = (1 / (1 + np.exp(-(both @ self.params["out"] + self.params["base"][0]))) - y) * mask / mask.sum()
        grads = {"out": np.einsum("tn,tnh->h", d, both), "base": np.array([d.sum()])}
        dx = np.zeros_like(x)
        width = x.shape[2]
        for side, lanes in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
            w = self.params[f"w{side}"]
            dw, db = np.zeros_like(w), np.zeros(4 * HIDDEN)
            dh, dc = np.zeros((x.shape[1], HIDDEN)), np.zeros((x.shape[1], HIDDEN))
            for t, h_old, c_old, i, f, o, g, tanh_c in reversed(runs[side][1]):
                live = mask[t][:, None]
                dh = dh + d[t][:, None] * self.params["out"][lanes]
                through = np.where(live, dh, 0)
                dct = np.where(live, dc, 0) + through * o * (1 - tanh_c**2)
                dgates = np.concatenate((dct * g * i * (1 - i), dct * c_old * f * (1 - f), through * tanh_c * o * (1 - o), dct * i * (1 - g**2)), axis=1)
                dw[:width] += x[t].T @ dgates
                dw[width:] += h_old.T @ dgates
                db += dgates.sum(axis=0)
                dx[t] += dgates @ w[:width].T
                dh = np.where(live, dgates @ w[width:].T, dh)
                dc = np.where(live, dct * f, dc)
            grads[f"w{side}"], grads[f"c{side}"] = dw, db
        at = dx[where["step"], where["page"]]
        for name, lanes in (("path", slice(0, PATH_SIZE)), ("word", slice(PATH_SIZE, PATH_SIZE + WORD_SIZE))):
            ids, owner, weight = where["bags"][name]
            g = np.zeros_like(self.params[name])
            np.add.at(g, ids, at[owner, lanes] * weight[:, None])
            grads[name] = g
        return grads


def train(pages: list[str]) -> Labeller:
    """Adam on the log loss of blocks whose plain markup tells what they are, each page in several variants."""
    model, draw = Labeller(), np.random.default_rng(SEED)
    known = []
    for page in pages:
        told = [(b, plain_label(b.path)) for b in blocks(page)]
        told = [(b, kind) for b, kind in told if kind]
        if any(kind == "content" for _, kind in told):
            known.append(told)
    rows = []
    for told in known:
        rows.append([(b.path, b.text, int(kind == "content")) for b, kind in told])
        rows += [variant(told, draw) for _ in range(VARIANTS)]
    samples = [([features(path, text) for path, text, _ in row], [y for _, _, y in row]) for row in rows]
    samples.sort(key=lambda s: len(s[1]))
    batches = [samples[k : k + BATCH] for k in range(0, len(samples), BATCH)]
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in model.params.items()}
    step = 0
    for epoch in range(EPOCHS):
        for k in draw.permutation(len(batches)):
            step += 1
            rate = RATE * (1 - epoch / EPOCHS) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for name, g in model.gradients([s[0] for s in batches[k]], [s[1] for s in batches[k]]).items():
                m, v = moments[name]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                model.params[name] -= rate * m / (np.sqrt(v) + 1e-8)
    return model


def fit(pages: DataFrame) -> Labeller:
    """Learns from at most SAMPLE_PAGES pages, chosen by a hash of page_id; only the chosen ones' html goes to the driver."""
    ids = pages.where("page_id IS NOT NULL AND html IS NOT NULL").select("page_id").distinct()
    ids = ids.orderBy(F.xxhash64(F.col("page_id").cast("string")), "page_id").limit(SAMPLE_PAGES)
    # A bounded number of ids. Rows that repeat an id come once each, the least html of it.
    some = pages.where("html IS NOT NULL").join(F.broadcast(ids), "page_id").groupBy("page_id").agg(F.min("html").alias("html"))
    return train(sorted(r["html"] for r in some.select("html").collect()))


def taken(labeller: Labeller, pages: list[str]) -> list[str]:
    """The main text of each page; pages of like length run together, so that what is padded stays small."""
    found = [blocks(page) for page in pages]
    out = [""] * len(found)
    order = sorted((k for k in range(len(found)) if found[k]), key=lambda k: len(found[k]))
    at = 0
    while at < len(order):
        some, size = [order[at]], sum(len(b.text) for b in found[order[at]])
        while at + len(some) < len(order) and (len(some) + 1) * len(found[order[at + len(some)]]) <= 8192:
            size += sum(len(b.text) for b in found[order[at + len(some)]])
            if size > 1 << 20:
                break
            some.append(order[at + len(some)])
        at += len(some)
        for k, p in zip(some, labeller.probabilities([list(map(block_features, found[k])) for k in some])):
            out[k] = "\n".join(b.text for b, take in zip(found[k], p >= THRESHOLD) if take)
    return out


def extractor(model: Labeller):
    """A column function: html to the text of the blocks taken as content, joined by line feeds."""
    params = {k: v.astype(np.float32).astype(np.float64) for k, v in model.params.items()}

    @F.arrow_udf("string")
    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        labeller = Labeller()
        labeller.params = params
        for texts in batches:
            yield pa.array([main for group in text_groups(texts) for main in taken(labeller, group)], pa.string())

    return extract


def main_text(pages: DataFrame) -> DataFrame:
    """``row`` (all input columns) and ``main_text``.

    A null, empty or textless page has the empty text. Where no page of the
    sample says plainly what its parts are, the labeller is untrained and its
    output arbitrary. Repeated rows get equal results; an empty table gives no
    rows. Scale: one small model goes out; extraction has no shuffle.
    """
    extract = extractor(fit(pages))
    return pages.select(F.struct("*").alias("row"), extract(whole_text(F.col("html"))).alias("main_text"))
