"""Main text of web pages by a recurrent labeller of blocks.

A page is cut into leaf blocks: runs of text between block-level tags. Each block has a vector of its tag path (tags
and the words of class, id and role), of its hashed words, and of a few sizes. A bidirectional LSTM in numpy reads the
blocks of a page in order, so that every label depends on the whole page, and says which blocks are the article.

Nothing is hand-labelled. The labeller is fitted on a bounded sample: about `FIT_PAGES` pages, of which those count whose
own markup names the article, and `FIT_PAGES` made-up layouts with menus, banners, sidebars, notices, adverts, forms and
reader comments, filled with words of the sampled pages. `UNNAMED` of the made-up parts bear meaningless class names, so
that labels also rest on tags, links, sizes, words and neighbours. It is then applied to every page, from its whole
html; all words of a block are read.

Text of script, style and template is never a block. Character references are decoded, white space in a block becomes
one space, blocks are trimmed and joined by a line break. A tag that isn't closed by the end of the page ends the page. Very
long pages and deep nesting take time in proportion to their length; their vectors are made window by window. Null and empty html give an empty text. Rows are
independent, so repeated rows repeat; columns named like the result are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.text_codes import with_scores

#: Pages to learn from.
FIT_PAGES = 300
PATH, WORDS, SIZES, HIDDEN = 128, 32, 4, 24
EPOCHS, BATCH, RATE = 12, 30, 0.01
#: Pages of more blocks are labelled by windows of so many.
WINDOW = 4096
#: Share of made-up parts with meaningless names.
UNNAMED = 0.35

#: Tags that begin or end a block, tags without content, tags whose content is no text.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html label legend li main nav ol optgroup option p pre section select summary table tbody td "
    "textarea tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style template".split())
#: An opening tag closes open ones of the second kind.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
PARAGRAPH_ENDS = BLOCK_TAGS - {"button", "label", "option", "optgroup", "select", "textarea", "legend"}

#: Names that pages give to what is not the article, for made-up layouts and for reading markup.
OTHER_NAMES = {
    "nav": "nav navbar navigation menu topnav mainmenu breadcrumb breadcrumbs tabs pagination pager toc links",
    "header": "header masthead banner topbar site branding logo head top",
    "footer": "footer foot bottom copyright colophon legal sitefooter imprint",
    "aside": "sidebar aside related widget side rail recommended trending popular promo more",
    "notice": "cookie cookies consent notice alert popup modal newsletter subscribe gdpr message banner overlay signup",
    "ad": "ad ads advert advertisement sponsored sponsor promo promotion banner adsense",
    "form": "form search login signup contact subscribe newsletter",
    "comments": "comments comment replies discussion disqus reply responses thread respond",
    "share": "share social sharing tags meta byline toolbar",
}
MAIN_NAMES = "article content post entry story main body text maincontent".split()
NOT_MAIN = frozenset(w for k, v in OTHER_NAMES.items() for w in v.split() if w not in ("main", "top", "head", "site", "side", "more", "text", "message", "thread")) | {"nav", "footer", "aside", "form", "button", "select", "option", "textarea", "label", "title", "dialog"}

#: A comment ends at once at <!--> and <!--->, and else at the first --> or --!>.
_COMMENT = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</(?![a-zA-Z])[^>]*+(?:>|\Z)", re.S)
#: Attributes up to the end of the tag; a quote counts only behind an equals sign, and only if it is closed.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=(?:\s*+(?:\"[^\"]*+\"|'[^']*+'))?+)*+)>", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>]++)", re.I)
_WORD = re.compile(r"[a-z]+")


@dataclass
class Block:
    path: np.ndarray  # bool, PATH: which slots of tag and class names are open
    text: str
    linked: float  # share of linked text
    main: bool  # inside an article or main part, and in nothing of it that has another name
    title: bool  # the page's title


class _Open:
    """The open tags of a page, with what holds for all of them kept up to date as tags open and close."""

    def __init__(self):
        self.stack: list[tuple] = []
        self.places: dict[str, list[int]] = {}
        self.outer: list[int] = []  # places of block tags other than div and p
        self.slots = np.zeros(PATH, np.int32)
        self.main_at, self.other, self.titles = -1, 0, 0

    def push(self, tag: str, names: list[str]) -> None:
        at, slots, other = len(self.stack), [], False
        self.places.setdefault(tag, []).append(at)
        if tag in BLOCK_TAGS:
            if tag not in ("div", "p"):
                self.outer.append(at)
            parts = [tag, *names]
            slots = list({_slot(n, PATH) for n in parts})
            for k in slots:
                self.slots[k] += 1
            self.titles += "title" in parts
            if self.main_at < 0 and ("article" in parts or "main" in parts):
                self.main_at = at
            if self.main_at >= 0 and not NOT_MAIN.isdisjoint(parts):
                other = True
                self.other += 1
        self.stack.append((tag, slots, other, "title" in names or tag == "title"))

    def pop(self) -> bool:
        """Closes the innermost tag; says whether it bounds a block."""
        tag, slots, other, title = self.stack.pop()
        at = len(self.stack)
        self.places[tag].pop()
        if self.outer and self.outer[-1] == at:
            self.outer.pop()
        for k in slots:
            self.slots[k] -= 1
        self.other -= other
        self.titles -= title and tag in BLOCK_TAGS
        if self.main_at == at:
            self.main_at = -1
        return tag in BLOCK_TAGS

    def last(self, tag: str) -> int:
        places = self.places.get(tag)
        return places[-1] if places else -1


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page that aren't empty, in page order, in one pass."""
    out, open_, parts, linked = [], _Open(), [], 0

    def end() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append(Block(open_.slots > 0, text, min(1.0, linked / max(1, len(text))), open_.main_at >= 0 and not open_.other, open_.titles > 0))
        parts.clear()
        linked = 0

    def close(k: int) -> None:
        if any(tag in BLOCK_TAGS for tag, *_ in open_.stack[k:]):
            end()
        while len(open_.stack) > k:
            open_.pop()

    at, size = 0, len(page)
    while at < size:
        if page[at] != "<" or not (at + 1 < size and (page[at + 1] in "!?/" or page[at + 1].isalpha())):
            to = page.find("<", at + 1)
            to = size if to < 0 else to
            parts.append(page[at:to])
            linked += to - at if open_.places.get("a") else 0
            at = to
            continue
        m = _TAG.match(page, at)
        if m is None:
            other = _COMMENT.match(page, at)
            if other:
                at = other.end()
                continue
            if page[at + 1] == "/" or page[at + 1].isascii():
                break  # the tag isn't closed by the end of the page
            parts.append("<")
            at += 1
            continue
        at, tag = m.end(), m[2].lower()
        if m[1]:
            k = open_.last(tag)
            if k >= 0:
                close(k)
            continue
        if tag in RAW_TAGS:
            stop = _RAW_ENDS[tag].search(page, at)
            at = stop.end() if stop else size
            continue
        if tag == "br":
            parts.append(" ")
        if tag in BLOCK_TAGS:
            end()
            if tag in PARAGRAPH_ENDS and open_.last("p") >= 0:
                close(open_.last("p"))
            while tag in CLOSES and open_.outer and open_.stack[open_.outer[-1]][0] in CLOSES[tag]:
                close(open_.outer[-1])
        if tag not in VOID_TAGS and not m[3].endswith("/"):
            open_.push(tag, [w for n in _NAMES.findall(m[3]) for w in _WORD.findall(n.lower())])
    if open_.stack:
        close(0)
    end()
    return out


_RAW_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for tag in RAW_TAGS}


class _Slots(dict):
    """The slot of each word, remembered while there are few."""

    def __init__(self, size: int, most: int = 200_000):
        super().__init__()
        self.size, self.most = size, most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = slot = zlib.crc32(word.encode()) % self.size
        return slot


_SLOTS = {PATH: _Slots(PATH), WORDS: _Slots(WORDS)}


def _slot(word: str, size: int) -> int:
    return _SLOTS[size][word]


def features(blocks: list[Block], first: int = 0, of: int | None = None) -> np.ndarray:
    """(blocks, PATH + WORDS + SIZES) vectors of a page's blocks, or of a run of them: the `first` and on of `of`."""
    of = len(blocks) if of is None else of
    x, slots = np.zeros((len(blocks), PATH + WORDS + SIZES), np.float32), _SLOTS[WORDS].__getitem__
    for i, b in enumerate(blocks):
        x[i, :PATH] = b.path
        words = b.text.lower().split()
        counts = np.bincount(np.fromiter(map(slots, words), np.int64, len(words)), minlength=WORDS)
        x[i, PATH : PATH + WORDS] = counts
        x[i, PATH : PATH + WORDS] /= np.sqrt(counts @ counts)
        x[i, -SIZES:] = (np.log1p(len(words)) / 5, b.linked, (first + i) / of, b.text[-1] in ".!?…")
    return x


@dataclass
class BlockLabeller:
    forward: tuple[np.ndarray, np.ndarray, np.ndarray]  # input, recurrent and bias weights
    backward: tuple[np.ndarray, np.ndarray, np.ndarray]
    out: np.ndarray
    bias: float


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _run(weights: tuple, x: np.ndarray, mask: np.ndarray, state: tuple | None = None, tape: list | None = None) -> tuple[np.ndarray, tuple]:
    """Hidden states (pages, steps, HIDDEN) of one direction, from `state` on, and the last state.

    What the way back needs goes to `tape`, if there is one.
    """
    w, u, b = weights
    n, steps, _ = x.shape
    h, c = state or (np.zeros((n, HIDDEN), x.dtype), np.zeros((n, HIDDEN), x.dtype))
    given, states = x @ w + b, np.zeros((n, steps, HIDDEN), x.dtype)
    for t in range(steps):
        z = given[:, t] + h @ u
        i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(z[:, 3 * HIDDEN :])
        c2 = f * c + i * g
        tc = np.tanh(c2)
        m = mask[:, t : t + 1]
        if tape is not None:
            tape.append((h, c, i, f, o, g, tc))
        h, c = np.where(m, o * tc, h), np.where(m, c2, c)
        states[:, t] = h
    return states, (h, c)


def _back(weights: tuple, x: np.ndarray, mask: np.ndarray, tape: list, d_states: np.ndarray) -> list[np.ndarray]:
    """Gradients of the weights of one direction."""
    w, u, b = weights
    n, steps, _ = x.shape
    dz_all = np.zeros((n, steps, 4 * HIDDEN), x.dtype)
    du, dh, dc = np.zeros_like(u), np.zeros((n, HIDDEN), x.dtype), np.zeros((n, HIDDEN), x.dtype)
    for t in range(steps - 1, -1, -1):
        h, c, i, f, o, g, tc = tape[t]
        m = mask[:, t : t + 1]
        dh = dh + d_states[:, t]
        live_h, live_c = dh * m, dc * m
        d = live_h * o * (1 - tc * tc) + live_c
        dz = np.concatenate((d * g * i * (1 - i), d * c * f * (1 - f), live_h * tc * o * (1 - o), d * i * (1 - g * g)), axis=1)
        dz_all[:, t] = dz
        du += h.T @ dz
        dh = np.where(m, dz @ u.T, dh)
        dc = np.where(m, d * f, dc)
    flat = dz_all.reshape(-1, 4 * HIDDEN)
    return [x.reshape(-1, x.shape[2]).T @ flat, du, flat.sum(axis=0)]


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x, mask = np.zeros((len(pages), steps, PATH + WORDS + SIZES), np.float32), np.zeros((len(pages), steps), bool)
    for i, p in enumerate(pages):
        x[i, : len(p)], mask[i, : len(p)] = p, True
    return x, mask


def _logits(model: BlockLabeller, x: np.ndarray, mask: np.ndarray, taped: bool = False) -> tuple[np.ndarray, tuple]:
    tape1, tape2 = ([], []) if taped else (None, None)
    ahead, _ = _run(model.forward, x, mask, tape=tape1)
    turned, turned_mask = x[:, ::-1], mask[:, ::-1]
    behind, _ = _run(model.backward, turned, turned_mask, tape=tape2)
    both = np.concatenate((ahead, behind[:, ::-1]), axis=2)
    return both @ model.out + model.bias, (both, tape1, turned, turned_mask, tape2)


def learn(pages: list[tuple[np.ndarray, np.ndarray]], seed: int = 7) -> BlockLabeller:
    """Fits the labeller to (vectors, labels) of pages, by Adam on the cross-entropy of blocks."""
    rng = np.random.default_rng(seed)
    size = PATH + WORDS + SIZES

    def start():
        b = np.zeros(4 * HIDDEN, np.float32)
        b[HIDDEN : 2 * HIDDEN] = 1
        return [rng.normal(0, 0.1, (size, 4 * HIDDEN)).astype(np.float32), rng.normal(0, 0.1, (HIDDEN, 4 * HIDDEN)).astype(np.float32), b]

    params = [*start(), *start(), rng.normal(0, 0.1, 2 * HIDDEN).astype(np.float32), np.zeros(1, np.float32)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    pages = [p for p in pages if len(p[0])]
    for _ in range(EPOCHS if pages else 0):
        order = rng.permutation(len(pages))
        for lo in range(0, len(order), BATCH):
            some = [pages[i] for i in order[lo : lo + BATCH]]
            x, mask = _padded([p for p, _ in some])
            y = np.zeros(mask.shape, np.float32)
            for i, (_, label) in enumerate(some):
                y[i, : len(label)] = label
            model = BlockLabeller(tuple(params[:3]), tuple(params[3:6]), params[6], float(params[7][0]))
            logit, (both, tape1, turned, turned_mask, tape2) = _logits(model, x, mask, taped=True)
            d = ((_sigmoid(logit) - y) * mask / mask.sum()).astype(np.float32)
            d_both = d[:, :, None] * model.out
            grads = [
                *_back(model.forward, x, mask, tape1, d_both[:, :, :HIDDEN]),
                *_back(model.backward, turned, turned_mask, tape2, d_both[:, ::-1, HIDDEN:]),
                np.einsum("ps,psh->h", d, both),
                np.array([d.sum()], np.float32),
            ]
            step += 1
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return BlockLabeller(tuple(params[:3]), tuple(params[3:6]), params[6], float(params[7][0]))


def label(model: BlockLabeller, pages: list[np.ndarray]) -> list[np.ndarray]:
    """For each page, which of its blocks are the article; pages of like length run together."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and hi - lo < 256 and (hi - lo + 1) * len(pages[order[hi]]) <= 20_000:
            hi += 1
        x, mask = _padded([pages[i] for i in order[lo:hi]])
        logit, _ = _logits(model, x, mask)
        for k, i in enumerate(order[lo:hi]):
            out[i] = logit[k, : len(pages[i])] > 0
        lo = hi
    return out


def label_long(model: BlockLabeller, blocks: list[Block], window: int = WINDOW) -> np.ndarray:
    """Labels of one page's blocks, read window by window in both directions; only states go from one to the next.

    Memory beside the blocks is a window's vectors and one number a block.
    """
    score, starts = np.full(len(blocks), model.bias), range(0, len(blocks), window)
    for weights, out, order, step in ((model.forward, model.out[:HIDDEN], starts, 1), (model.backward, model.out[HIDDEN:], starts[::-1], -1)):
        state = None
        for lo in order:
            x = features(blocks[lo : lo + window], lo, len(blocks))[None, ::step]
            states, state = _run(weights, x, np.ones(x.shape[:2], bool), state)
            score[lo : lo + window] += (states[0] @ out)[::step]
    return score > 0


def marked(blocks: list[Block]) -> np.ndarray | None:
    """Labels that the page's own markup gives, if it names an article."""
    named = _slot("article", PATH), _slot("main", PATH)
    if not any(b.path[k] for b in blocks for k in named) or not any(b.main for b in blocks):
        return None
    return np.array([b.main for b in blocks], np.float32)


def made_up(rng: random.Random, words: list[str]) -> tuple[str, set[str]]:
    """A page of a random layout, and the texts of its article."""
    main: set[str] = set()

    def text(n: int) -> str:
        return " ".join(rng.choice(words) for _ in range(n)).capitalize() + rng.choice([".", ".", ".", "", "!"])

    def prose(n: int) -> str:
        out = []
        for _ in range(n):
            t = text(rng.choice([3, 8, 20, 40, 80]))
            main.add(" ".join(t.split()))
            tag = rng.choice(["p", "p", "p", "p", "h2", "li", "blockquote", "div", "pre"])
            out.append(f"<ul><li>{t}</li></ul>" if tag == "li" else f"<{tag}>{t}</{tag}>" if rng.random() < 0.9 or tag != "p" else f"<p><b>{t}<br>")
        return "".join(out)

    def nonsense() -> str:
        return "".join(rng.choice("bcdfghjklmnpqrstvwxz") + rng.choice("aeiou") for _ in range(rng.randrange(2, 4)))

    def named(kind: str, tag: str) -> str:
        name = nonsense() if rng.random() < UNNAMED else rng.choice(OTHER_NAMES[kind].split())
        how = rng.choice([f' class="{name}"', f' id="{name}"', f' class="{name}-{rng.choice(["box", "wrap", "list", "inner"])}"', f' class="{rng.choice(["x", "col", "row"])} {name}"'])
        return f"{tag}{how}" if tag in ("div", "section", "ul", "p", "span", "form") or rng.random() < 0.4 else tag

    def other(kind: str) -> str:
        tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind, "div")
        tag = rng.choice([tag, tag, "div", "section"]) if kind != "form" else "form"
        first = named(kind, tag)
        if kind == "nav" or (kind in ("aside", "footer", "share") and rng.random() < 0.4):
            inner = "<ul>" + "".join(f'<li><a href="/{i}">{text(rng.choice([1, 1, 2, 4]))}</a></li>' for i in range(rng.randrange(2, 9))) + "</ul>"
        elif kind == "form":
            inner = f'<label>{text(2)}</label><input name="q"><button>{text(1)}</button>'
        elif kind == "comments":
            inner = f"<h3>{text(2)}</h3>" + "".join(f'<div class="{rng.choice(["comment", "reply", "item", "author"])}"><p>{text(rng.choice([4, 12, 30, 60]))}</p></div>' for _ in range(rng.randrange(1, 6)))
        else:
            inner = "".join(rng.choice(["<p>{}</p>", "{}", "<div>{}</div>", "<h3>{}</h3>"]).format(text(rng.choice([2, 6, 12, 30]))) for _ in range(rng.randrange(1, 4)))
        return f"<{first}>{inner}</{tag}>"

    title = text(5)
    main.add(" ".join(title.split()))
    shell = rng.choice(["article", "article", "main", "div", "section"])
    name = "" if shell in ("article", "main") and rng.random() < 0.6 else f' class="{nonsense() if rng.random() < UNNAMED else rng.choice(MAIN_NAMES)}"'
    inside = [f"<h1>{title}</h1>", *(prose(rng.randrange(1, 5)) for _ in range(rng.randrange(1, 4)))]
    for kind in ("ad", "share", "aside", "notice", "form", "comments"):
        if rng.random() < 0.25:
            inside.insert(len(inside) if kind == "comments" else rng.randrange(1, len(inside) + 1), other(kind))
    before = [other(k) for k in ("notice", "header", "nav", "ad", "form", "aside") if rng.random() < 0.5]
    after = [other(k) for k in ("comments", "aside", "share", "ad", "notice", "form", "footer") if rng.random() < 0.5]
    page = f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body>{''.join(before)}<{shell}{name}>{''.join(inside)}</{shell}>{''.join(after)}</body></html>"
    return page, main


def fit_labeller(pages: DataFrame, html_col: str = "html", fit_pages: int = FIT_PAGES) -> BlockLabeller:
    """Learns from about `fit_pages` pages, chosen by a hash of the html, and as many made-up layouts.

    Equal pages are drawn once, so the sample is the same in whatever order the rows come.
    """
    rows = pages.select(F.col(html_col).alias("h")).where(F.length("h") > 0)
    n = rows.count()
    draw = F.pmod(F.xxhash64("h"), F.lit(1_000_000)) / 1_000_000
    some = rows.where(draw < min(1.0, fit_pages / max(1, n))).distinct().collect()
    examples, vocabulary = [], set()
    for h in sorted(r["h"] for r in some):
        blocks = blocks_of(h)
        y = marked(blocks)
        vocabulary.update(w for b in blocks for w in b.text.split())
        if y is not None:
            examples.append((features(blocks), y))
    rng, words = random.Random(11), sorted(vocabulary) or "the of and to in is that for on with".split()
    for _ in range(fit_pages):
        page, main = made_up(rng, words)
        blocks = blocks_of(page)
        examples.append((features(blocks), np.array([b.text in main and not b.title for b in blocks], np.float32)))
    return learn(examples)


def extract(model: BlockLabeller, pages: list[str]) -> list[str]:
    blocks = [blocks_of(p) for p in pages]
    keep = label(model, [features(b) if len(b) <= WINDOW else features([]) for b in blocks])
    keep = [label_long(model, b) if len(b) > WINDOW else k for b, k in zip(blocks, keep, strict=True)]
    return ["\n".join(b.text for b, k in zip(page, ks, strict=False) if k) for page, ks in zip(blocks, keep, strict=True)]


def extract_main_text(df: DataFrame, model: BlockLabeller, html_col: str = "html", out_col: str = "main_text") -> DataFrame:
    """All columns of `df` and the page's main text."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def score(model, pages):
        return [pa.array(extract(model, pages), pa.string())]

    return with_scores(df, html_col, f"{out_col} string", score, shared)
