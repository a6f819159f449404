"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks, the runs of text between block-level tags, each with the path
of its open elements (tags, classes, ids, roles). A block's vector joins hashed embeddings of
its path and of its words with a few counts; a bidirectional LSTM in numpy reads the vectors
of the whole page in order and labels every block as main text or not.

No page here has labels, so the network is trained on pages that ``sample_page`` composes:
many layouts with and without semantic tags, menus, headers, footers, sidebars, notices,
adverts, forms, share bars, related links and reader comments around or inside an article.

Defined results: null or empty html gives no blocks and the empty text; scripts, styles,
templates, controls and comments of the markup are never blocks; unclosed and stray tags are
taken as browsers do for paragraphs, list items and cells, a ``<`` that opens no complete tag
is text; pages of any length and depth are read whole, in a time linear in their size (a path
of more than ``OUTER + INNER`` block elements is known by its ends); repeated rows are each
read, an empty table gives an empty one; other columns stay, one named as the output is
replaced.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Codes, per_slice, table

_BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements read to their end tag as raw text, and elements whose text is never shown as prose.
_RAW = "script|style|template|noscript|iframe|textarea|title"
_HIDDEN = frozenset("svg object select button canvas audio video math datalist".split())
_PARAGRAPH = frozenset({"p"})
_CLOSES = {k: _PARAGRAPH | v for k, v in {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}}.items()}
_ATTRS = r"""(?:"[^"]*"|'[^']*'|[^'"<>])*+"""
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{_RAW})(?![\w:-]){_ATTRS}>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^<>]*>|<(?P<end>/)?(?P<tag>[a-zA-Z][\w:-]*+)(?P<attrs>{_ATTRS})>|(?P<text>[^<]+|<)", re.S | re.I
)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME = re.compile(r"[a-z]+")
#: Of a path the outermost and innermost elements are read, and of an element so many names.
OUTER, INNER, NAMES = 8, 24, 16
PATHS, WORDS, PATH_DIM, WORD_DIM, HIDDEN, COUNTS, AT_ONCE = 1 << 12, 1 << 12, 12, 6, 16, 6, 1 << 14


def blocks(page: str | None) -> list[tuple[str, tuple[str, ...], int]]:
    """Text, path and linked characters of each leaf block in page order."""
    out: list[tuple[str, tuple[str, ...], int]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    blocks_at: list[int] = []
    opened: Counter[str] = Counter()
    held: list[str] = []
    linked = hidden = 0

    def flush() -> None:
        nonlocal held, linked
        text = " ".join(entities.unescape("".join(held)).split()) if held else ""
        if text:
            at = blocks_at if len(blocks_at) <= OUTER + INNER else blocks_at[:OUTER] + blocks_at[-INNER:]
            out.append((text, tuple(x for i in at for x in stack[i][1]), linked))
        held, linked = [], 0

    def cut(i: int) -> None:
        """Close the elements from place ``i`` of the stack on."""
        nonlocal hidden
        for tag, _ in stack[i:]:
            opened[tag] -= 1
            hidden -= tag in _HIDDEN
        del stack[i:]
        while blocks_at and blocks_at[-1] >= i:
            blocks_at.pop()

    for m in _TOKEN.finditer(page or ""):
        text = m["text"]
        if text is not None:
            if not hidden:
                held.append(text)
                linked += len(text) * (opened["a"] > 0)
            continue
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        block = tag in _BLOCK
        if block:
            flush()
        elif tag == "br":
            held.append(" ")
        if m["end"]:
            if opened[tag]:
                cut(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
        elif tag not in _VOID and not m["attrs"].rstrip().endswith("/"):
            while block and blocks_at and stack[blocks_at[-1]][0] in _CLOSES.get(tag, _PARAGRAPH):
                cut(blocks_at[-1])
            names = tuple(f"{a.lower()}={x}" for a, *v in _ATTR.findall(m["attrs"]) for x in _NAME.findall("".join(v).lower()))[:NAMES] if m["attrs"] else ()
            if block:
                blocks_at.append(len(stack))
            stack.append((tag, (tag, *names)))
            opened[tag] += 1
            hidden += tag in _HIDDEN
    flush()
    return out


class Labeller:
    """Embeddings and a bidirectional LSTM with a logistic output per block."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        inputs = PATH_DIM + WORD_DIM + COUNTS
        self.params = {"path": rng.normal(0, 0.3, (PATHS, PATH_DIM)), "word": rng.normal(0, 0.1, (WORDS, WORD_DIM)), "out": rng.normal(0, 0.3, 2 * HIDDEN), "bias": np.zeros(1)}
        for side in "fb":
            self.params["w" + side] = rng.normal(0, 1 / np.sqrt(inputs + HIDDEN), (inputs + HIDDEN, 4 * HIDDEN))
            self.params["c" + side] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
        self.params = {k: v.astype(np.float32) for k, v in self.params.items()}

    @staticmethod
    def read(pages: list[list[tuple[str, tuple[str, ...], int]]]):
        """Hashed paths and words of all blocks, flat with offsets, and the counts."""
        words, items = Codes(), Codes()
        w_flat, w_len, p_flat, p_len, counts = [], [], [], [], []
        for page in pages:
            for k, (text, path, linked) in enumerate(page):
                ws = text.lower().split()
                w_flat += [words[x] for x in ws]
                w_len.append(len(ws))
                last = path[-1] if path else ""
                keys = ["", *path, f"leaf {last}", *(f"{d} {x}" for d, x in enumerate(path[-2:]))]
                p_flat += [items[x] for x in keys]
                p_len.append(len(keys))
                counts.append((np.log1p(len(ws)) / 3, np.log1p(len(text)) / 5, linked / len(text), sum(map(text.count, ".,;:!?")) / len(ws), k / len(page), 1 / len(page)))
        h = xxhash.xxh3_64_intdigest
        word_at = np.array([h(x) % WORDS for x in words], np.int64)
        item_at = np.array([h(x) % PATHS for x in items], np.int64)
        return word_at[np.array(w_flat, np.int64)], np.array(w_len), item_at[np.array(p_flat, np.int64)], np.array(p_len), np.array(counts, np.float32).reshape(-1, COUNTS)

    def inputs(self, read) -> np.ndarray:
        w, w_len, p, p_len, counts = read
        mean = lambda e, flat, n: np.add.reduceat(e[flat], np.cumsum(n) - n) / n[:, None]
        return np.concatenate([mean(self.params["path"], p, p_len), mean(self.params["word"], w, w_len), counts], 1).astype(np.float32)

    def _pass(self, x: np.ndarray, mask: np.ndarray, side: str, taped: bool = True) -> tuple[np.ndarray, list]:
        """One direction over a padded batch (time x pages x inputs); masked steps keep the state."""
        w, c0, tape = self.params["w" + side], self.params["c" + side], []
        h = c = np.zeros((x.shape[1], HIDDEN), np.float32)
        out = np.zeros((*x.shape[:2], HIDDEN), np.float32)
        for t in range(len(x)) if side == "f" else range(len(x) - 1, -1, -1):
            joined = np.concatenate([x[t], h], 1)
            z = joined @ w + c0
            gates = 1 / (1 + np.exp(-np.clip(z[:, : 3 * HIDDEN], -30, 30)))
            i, f, o, g = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            new_c = f * c + i * g
            th = np.tanh(new_c)
            m = mask[t][:, None]
            if taped:
                tape.append((t, joined, i, f, o, g, c, th, m))
            c, h = m * new_c + (1 - m) * c, m * (o * th) + (1 - m) * h
            out[t] = h
        return out, tape

    def _back(self, grad: np.ndarray, tape: list, side: str, into: dict) -> np.ndarray:
        w, n = self.params["w" + side], grad.shape[2]
        dx = np.zeros((*grad.shape[:2], w.shape[0] - HIDDEN), np.float32)
        dh = dc = np.zeros(grad.shape[1:], np.float32)
        for t, joined, i, f, o, g, c, th, m in reversed(tape):
            dh = dh + grad[t]
            dhm = dh * m
            dn = dhm * o * (1 - th * th) + dc * m
            dz = np.concatenate([dn * g * i * (1 - i), dn * c * f * (1 - f), dhm * th * o * (1 - o), dn * i * (1 - g * g)], 1)
            into["w" + side] += joined.T @ dz
            into["c" + side] += dz.sum(0)
            back = dz @ w.T
            dx[t] = back[:, :-n]
            dh = back[:, -n:] + dh * (1 - m)
            dc = dn * f + dc * (1 - m)
        return dx

    def _pad(self, x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        col = np.repeat(np.arange(len(sizes)), sizes)
        row = np.arange(len(x)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        padded, mask = np.zeros((int(sizes.max()), len(sizes), x.shape[1]), np.float32), np.zeros((int(sizes.max()), len(sizes)), np.float32)
        padded[row, col], mask[row, col] = x, 1
        return padded, mask, (row, col)

    def logits(self, pages: list) -> list[np.ndarray]:
        """Per page the blocks' outputs; pages of like length are read together, ``AT_ONCE`` padded blocks at most (a longer page alone)."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        while order:
            n = 1
            while n < min(64, len(order)) and (n + 1) * len(pages[order[n]]) <= AT_ONCE:
                n += 1
            part, order = order[:n], order[n:]
            sizes = np.array([len(pages[i]) for i in part])
            x, mask, at = self._pad(self.inputs(self.read([pages[i] for i in part])), sizes)
            both = np.concatenate([self._pass(x, mask, "f", False)[0], self._pass(x, mask, "b", False)[0]], 2)
            z = (both @ self.params["out"] + self.params["bias"][0])[at]
            for i, piece in zip(part, np.split(z, np.cumsum(sizes)[:-1]), strict=True):
                out[i] = piece
        return out

    def fit(self, pages: list, labels: list[list[int]], epochs: int = 6, batch: int = 24, rate: float = 0.01, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.params.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(pages))
            for a in range(0, len(order), batch):
                part = [i for i in order[a : a + batch] if pages[i]]
                sizes = np.array([len(pages[i]) for i in part])
                read = self.read([pages[i] for i in part])
                x, mask, at = self._pad(self.inputs(read), sizes)
                (hf, tf), (hb, tb) = self._pass(x, mask, "f"), self._pass(x, mask, "b")
                both = np.concatenate([hf, hb], 2)
                z = both @ self.params["out"] + self.params["bias"][0]
                y = np.zeros_like(z)
                y[at] = np.concatenate([labels[i] for i in part])
                dz = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * mask / mask.sum()
                grad = {k: np.zeros_like(v) for k, v in self.params.items()}
                grad["out"] += np.tensordot(dz, both, 2)
                grad["bias"] += dz.sum()
                dh = dz[:, :, None] * self.params["out"]
                dx = (self._back(dh[:, :, :HIDDEN], tf, "f", grad) + self._back(dh[:, :, HIDDEN:], tb, "b", grad))[at]
                w, w_len, p, p_len, _ = read
                np.add.at(grad["path"], p, np.repeat(dx[:, :PATH_DIM] / p_len[:, None], p_len, 0))
                np.add.at(grad["word"], w, np.repeat(dx[:, PATH_DIM : PATH_DIM + WORD_DIM] / w_len[:, None], w_len, 0))
                step += 1
                for k, v in self.params.items():
                    m, s = moments[k]
                    m *= 0.9
                    m += 0.1 * grad[k]
                    s *= 0.999
                    s += 0.001 * grad[k] ** 2
                    v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)


_SYLLABLES = "the re on an er in ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur qu ei sch ñ é".split()
_ROLES = {
    "nav": ("menu nav navbar navigation topnav breadcrumbs pagination links", "nav ul div"),
    "header": ("header masthead top banner branding site", "header div"),
    "footer": ("footer bottom copyright legal colophon credits", "footer div"),
    "side": ("sidebar aside widget rail secondary related trending popular", "aside div section"),
    "notice": ("cookie consent notice banner alert gdpr popup modal overlay newsletter", "div section dialog p"),
    "ad": ("ad ads advert advertisement sponsor sponsored promo banner adbox", "div aside section ins p"),
    "form": ("form search login subscribe signup contact", "form div"),
    "comments": ("comments comment discussion replies respond thread disqus", "section div ol ul"),
    "share": ("share social sharing tools tags meta byline author", "div ul p"),
}
_CONTENT = "content article post entry story main body text prose page"
_BOILER_WORDS = "home login register search menu subscribe cookies accept privacy terms copyright © rights reserved share tweet reply next previous contact about sign newsletter advertisement sponsored comments related".split()


def sample_page(rng: random.Random) -> tuple[str, list[int]]:
    """A composed page, and for each of its leaf blocks whether it is main text."""
    labels: list[int] = []
    pool = ["".join(rng.choice(_SYLLABLES) for _ in range(rng.choice((1, 1, 2, 2, 3, 4)))) for _ in range(80)]

    def words(low: int, high: int, own: float = 0.0) -> str:
        out = [rng.choice(_BOILER_WORDS) if rng.random() < own else rng.choice(pool) for _ in range(rng.randint(low, high))]
        for i in range(rng.randint(4, 12), len(out), rng.randint(5, 14)):
            out[i] += rng.choice(".,.")
        return (" ".join(out)).capitalize() + rng.choice(("", ".", "."))

    def attrs(names: str, always: bool = False) -> str:
        if not always and rng.random() < 0.35:
            return ""
        name = "-".join(rng.sample(names.split(), rng.choice((1, 1, 2))))
        return f' {rng.choice(("class", "class", "id"))}="{name}"'

    def leaf(tag: str, text: str, label: int, more: str = "") -> str:
        labels.append(label)
        inner = rng.choice((text, text, text, f"<b>{text}<br>" if label else f"<a href=/x>{text}</a>", f"<span>{text}</span>"))
        return f"<{tag}{more}>{inner}" + (f"</{tag}>" if tag != "p" or rng.random() < 0.9 else "")

    def boiler(role: str) -> str:
        names, tags = _ROLES[role]
        tag = rng.choice(tags.split())
        more = attrs(names, always=tag in ("div", "section", "p", "ul", "ol", "ins"))
        own = rng.choice((0.0, 0.3, 0.7))
        if tag == "p" or (role in ("footer", "ad", "notice") and rng.random() < 0.5):
            labels.append(0)
            return f"<{tag}{more}>{words(1, 25, own)}</{tag}>"
        if tag in ("ul", "ol") or role == "nav" or rng.random() < 0.3:
            items = "".join(f"<li>{_item}</li>" for _item in (labels.append(0) or f'<a href="/{rng.choice(pool)}">{words(1, 4, own)}</a>' for _ in range(rng.randint(1, 9))))
            return f"<{tag}{more}>{items}</{tag}>" if tag in ("ul", "ol") else f"<{tag}{more}><ul>{items}</ul></{tag}>"
        if role == "comments":
            body = "".join(leaf(rng.choice(("p", "div", "li")), words(3, 60, own / 3), 0, attrs("comment reply user body")) for _ in range(rng.randint(1, 6)))
        else:
            body = "".join(leaf(rng.choice(("p", "div", "h3", "span" if False else "p")), words(1, 30, own), 0) for _ in range(rng.randint(1, 4)))
        return f"<{tag}{more}>{body}</{tag}>"

    def article() -> str:
        parts = [leaf(rng.choice(("h1", "h1", "h2")), words(2, 12), 1)] if rng.random() < 0.85 else []
        if rng.random() < 0.2:
            parts.append(boiler("share"))
        for _ in range(rng.randint(1, 14)):
            kind = rng.random()
            if kind < 0.72:
                parts.append(leaf("p" if rng.random() < 0.9 else "div", words(1, rng.choice((3, 12, 60, 120))), 1))
            elif kind < 0.8:
                parts.append(leaf(rng.choice(("h2", "h3")), words(1, 8), 1))
            elif kind < 0.86:
                parts.append("<ul>" + "".join(leaf("li", words(2, 20), 1) for _ in range(rng.randint(1, 4))) + "</ul>")
            elif kind < 0.9:
                parts.append("<blockquote>" + leaf("p", words(4, 40), 1) + "</blockquote>")
            elif kind < 0.94:
                parts.append(boiler(rng.choice(("ad", "share", "side", "form"))))
            else:
                parts.append(leaf("p", words(20, 80), 1))
        if rng.random() < 0.15:
            parts.append(boiler("comments"))
        return "".join(parts)

    before = [boiler(r) for r in ("header", "nav", "notice", "ad", "form") if rng.random() < 0.55]
    kind = rng.random()
    if kind < 0.5:
        main = f"<article{attrs(_CONTENT)}>{article()}</article>"
    elif kind < 0.7:
        main = f"<main{attrs(_CONTENT)}>{article()}</main>"
    elif kind < 0.95:
        main = f"<div{attrs(_CONTENT, True)}>{article()}</div>"
    else:
        main = article()
    if rng.random() < 0.3:
        main = f"<{rng.choice(('div', 'main', 'section'))}{attrs('container wrapper content page layout main')}>{main}"
    after = [boiler(r) for r in ("side", "ad", "comments", "share", "nav", "form", "notice", "footer") if rng.random() < 0.4]
    return f"<html><head><title>{words(2, 8)}</title></head><body>{''.join(before)}{main}{''.join(after)}</body></html>", labels


@functools.cache
def trained(pages: int = 1500, seed: int = 1) -> Labeller:
    """The labeller, fitted on ``pages`` composed pages (always the same for the same arguments)."""
    rng = random.Random(seed)
    made = [sample_page(rng) for _ in range(pages)]
    read = [(blocks(p), y) for p, y in made]
    read = [(b, y) for b, y in read if len(b) == len(y)]
    model = Labeller()
    model.fit([b for b, _ in read], [y for _, y in read])
    return model


def extract(df: DataFrame, model: Labeller | None = None, html: str = "html", text: str = "text") -> DataFrame:
    """``df`` plus the main text: kept blocks in page order, joined by an empty line."""
    model = model or trained()
    df = df.drop(text)
    schema = T.StructType([*df.schema.fields, T.StructField(text, T.StringType(), False)])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        pages = [blocks(p) for p in batch.column(html).to_pylist()]
        kept = ["\n\n".join(b[0] for b, z in zip(p, zs, strict=True) if z > 0) for p, zs in zip(pages, model.logits(pages), strict=True)]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(kept, pa.string())], [*batch.schema.names, text])

    return df.mapInArrow(per_slice(run, html), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
