"""HTML extraction: a recurrent labeller says of every block whether it is main text.

A page becomes its leaf blocks in order. A block's inputs are its tag path (hashed element
names and words of class, id and role of all open elements), its hashed words, and a few shares
and lengths. A bidirectional LSTM in numpy reads the blocks of the whole page both ways, and a
block is kept where the probability reaches one half. Kept blocks are joined in page order.

The network is fitted on the driver from a bounded sample: SAMPLE_PAGES pages with the smallest
hashes of their ids, of longer ones a run of SAMPLE_BLOCKS blocks from one that a checksum names. Pages have no
labels, so they are weak: what lies in an article or main element and not in an element that
is named as a menu, header, footer, sidebar, notice, advert, form or comment is good. Beside
the pages themselves the sample is laid out anew, LAYOUTS times in all: its texts in containers
drawn from the lists below, with and without telling names, with neutral and invented names
between, and texts of other kinds before, within and after the article; there labels are known.
These lists only make training pages; whether a block stays is the network's decision.

White space is Unicode's. Null or empty html, and pages without main text: an empty text. Very
long pages: whole, read in stretches of STEPS blocks that hand their state on. Null page_id or
url: kept as such. Repeated rows: the same text each. Ties don't arise. Further columns, also
of clashing names, are passed over. Empty table: empty result.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from html import escape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from leadweave.llm.common import batch_slices, give_back, pick
from leadweave.llm.html_blocks import PATH_BITS, Blocks, bit, blocks_of

SAMPLE_PAGES, SAMPLE_BLOCKS, LAYOUTS = 150, 60, 3000  # the sample: pages, blocks of each, layouts of all
WORD_BUCKETS, HIDDEN, THRESHOLD = 128, 24, 0.5
STEPS = 2048  # blocks of a page whose inputs are in memory at once
EPOCHS, BATCH, RATE, RIDGE, DROPPED = 8, 32, 0.01, 1e-5, 0.03
NUMBERS = 9
INPUTS = PATH_BITS + WORD_BUCKETS + NUMBERS

GOOD = ["article", "main", "article|post", "div|content", "div|article body", "div|post content", "div|entry content", "div|story", "section|text", "div|main content", "div|page body", "td|content", "div|text", "section|article", "div|blog post"]
BAD = {
    "menu": ["nav", "nav", "nav|main", "div|menu", "ul|nav", "div|navbar", "div|breadcrumbs", "ol|breadcrumb", "div|topnav", "div|navigation", "menu", "div|pagination", "div|toc"],
    "header": ["header", "header", "header|site", "div|header", "div|masthead", "div|site header", "div|top bar", "div|banner"],
    "footer": ["footer", "footer", "footer|page", "div|footer", "div|copyright", "div|site footer", "div|legal", "div|bottom", "small|copyright"],
    "sidebar": ["aside", "aside", "aside", "aside|left", "div|sidebar", "div|related", "div|widget", "section|related posts", "div|right column", "div|recommended", "div|side", "div|most read", "div|tags"],
    "notice": ["div|cookie", "div|cookie notice", "div|consent", "div|notice", "div|gdpr", "div|alert", "dialog|consent", "div|newsletter", "div|popup", "div|modal", "section|notice", "div|warning", "div|paywall", "p|notice"],
    "advert": ["div|ad", "div|ads", "div|advert", "div|advertisement", "aside|ad", "div|sponsored", "div|promo", "ins|adsbygoogle", "section|ad", "div|ad slot", "div|banner ad", "p|ad", "div|promotion"],
    "form": ["form", "form|search", "form|login", "fieldset", "form|contact", "div|subscribe form", "form|comment form"],
    "comments": ["section|comments", "div|comments", "div|comment", "ol|commentlist", "ul|comments", "div|comment list", "div|replies", "div|discussion", "div|respond", "section|discussion", "article|comment", "div|user comments", "div|reader comments"],
    "share": ["div|share", "div|social", "ul|social links", "div|share buttons"],
}
NEUTRAL = ["div", "div|container", "div|wrapper", "section", "div|row", "div|inner", "div|page", "div|col", "div|grid", "span", "table>tr>td", "center"]
#: Own phrases, for samples that have few of a kind.
PHRASES = {
    "menu": "Home|About us|Contact|News|Products|Login|Sign up|Help|Archive|Next|Previous|Services",
    "header": "Welcome to our site|Site title|The daily page|Log in|Search this site",
    "footer": "Copyright 2024 All rights reserved|Terms of use|Privacy policy|Powered by software|Imprint|Sitemap",
    "sidebar": "Related stories|Most read|You may also like|Recent posts|Tags|Popular this week|Archives",
    "notice": "We use cookies to improve your experience.|Accept all|This site uses cookies. By continuing you agree to our policy.|Subscribe to our newsletter|Please enable scripts|Your session will expire soon.",
    "advert": "Advertisement|Buy now and save|Sponsored|Best offers today only, click here|Special deal: order now",
    "form": "Name|E-mail|Send|Search|Password|Subscribe|Your message|Submit",
    "comments": "Great post, thanks!|Reply|I do not agree with this at all.|Leave a comment|3 comments|User wrote 2 days ago|Report",
    "share": "Share|Tweet|Print this page|E-mail to a friend",
    "article": "The council met on Tuesday to discuss the plans for the old harbour, and the debate went on until late in the evening.|Nobody had expected the river to rise so quickly.|After years of work the team published its results, which differ from earlier ones in two ways.|A short history|What happened next is still disputed.|He said that the new rules would help small firms, while larger ones had to wait.",
}
MARKS = ("\ue000", "\ue001")  # private characters: bad, good
LEAVES = {"article": ["p", "p", "p", "p", "p", "p", "h2", "ul>li", "ol>li", "blockquote", "div", "table>tr>td", "pre", "p>b", "figure>figcaption", "h3", "dl>dd"], "link": ["li>a", "a", "div>a", "li>a", "p>a", "span>a", ""], "plain": ["p", "p", "div", "span", "ul>li", "h1", "h2", "h3", "label", "h4", "p>b", "button", "blockquote>p", "", "", "a"]}


# --- training pages -------------------------------------------------------------------------


def weak_label(bits: int) -> bool:
    """Main text by the names on the path alone; for pages of the sample only."""
    named = {w for kinds in BAD.values() for k in kinds for w in _tokens(k) if w not in ("div", "section", "article", "ul", "ol", "p", "ins", "small", ".main", ".page", ".site", ".top", ".left", ".list", ".body", ".post", ".posts", ".side")}
    return any(bits & bit(t) for t in ("article", "main")) and not any(bits & bit(t) for t in named)


def _tokens(spec: str) -> list[str]:
    name, _, words = spec.partition("|")
    return [name, *("." + w for w in words.split())]


def _wrap(spec: str, inner: str, r: random.Random, hints: bool = True) -> str:
    """Inner markup in the elements of a spec: name|words, or names joined by >."""
    names = spec.split(">")
    for name in reversed(names):
        name, _, words = name.partition("|")
        attribute = ""
        if words and hints:
            key = r.choice(["class", "class", "id"])
            attribute = f' {key}="{r.choice(["-", "_", " "]).join(words.split())}"'
        inner = f"<{name}{attribute}>{inner}</{name}>"
    return inner


class _Layout:
    """A page laid out at random from texts of each kind; a mark at each text's end tells its label."""

    def __init__(self, good: list[str], bad: list[str], seed: int) -> None:
        self.r, self.good, self.bad = random.Random(seed), good, bad

    def invented(self) -> str:
        return "".join(self.r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(self.r.randint(3, 9)))

    def fragment(self, text: str, most: int) -> str:
        words = text.split()
        at = self.r.randrange(len(words))
        return " ".join(words[at : at + self.r.randint(1, most)])

    def leaf(self, text: str, spec: str, label: int) -> str:
        inner = escape(text) + MARKS[label]
        return _wrap(spec, inner, self.r) if spec else inner + " "

    def neutral(self, inner: str, chance: float) -> str:
        while self.r.random() < chance:
            spec = self.r.choice(NEUTRAL)
            if self.r.random() < 0.4:
                spec = f"div|{self.invented()} {self.invented()}"
            inner = _wrap(spec, inner, self.r, self.r.random() < 0.8)
        return inner

    def box(self, kind: str) -> str:
        """Texts of a kind in a container of it."""
        r = self.r
        link = kind in ("menu", "share") or (kind in ("sidebar", "footer", "header") and r.random() < 0.5)
        out = []
        for _ in range(r.randint(2, 7) if link else r.randint(1, 3)):
            text = r.choice(PHRASES[kind].split("|"))
            if self.good and not link and r.random() < (0.7 if kind == "comments" else 0.4):
                text = r.choice(self.good)
            elif r.random() < 0.6 and (self.bad or self.good):
                pool = self.good if self.good and r.random() < 0.5 else self.bad or self.good
                text = self.fragment(r.choice(pool), 4 if link else 18)
            out.append(self.leaf(text, r.choice(LEAVES["link" if link else "plain"]), 0))
        telling = r.random() < 0.9 or kind not in ("menu", "header", "footer", "form")
        spec = r.choice(BAD[kind])
        if not telling:
            spec = "div"
        return self.neutral(_wrap(spec, self.neutral("".join(out), 0.25), r), 0.25)

    def page(self) -> tuple[Blocks, list[int]]:
        r = self.r
        before = [self.box(k) for k in ("menu", "header", "notice", "advert", "share", "sidebar", "form") if r.random() < 0.42]
        spec = r.choice(GOOD) if r.random() < 0.85 else r.choice(NEUTRAL)
        own = list(self.good) or PHRASES["article"].split("|")
        if r.random() < 0.3:
            at = r.randrange(len(own))
            own = own[at : at + r.randint(1, 5)]
        parts = []
        for k, text in enumerate(own):
            if k and r.random() < 0.16:
                parts.append(self.box(r.choice(["advert", "share", "notice", "form", "sidebar", "sidebar", "comments", "menu"])))
            if r.random() < 0.1:
                text = r.choice(PHRASES["article"].split("|"))
            if k and r.random() < 0.12:  # a list, or short lines
                items = [self.leaf(self.fragment(text, 9), r.choice(["li", "li", "p"]), 1) for _ in range(r.randint(1, 5))]
                parts.append(_wrap(r.choice(["ul", "ol"]), "".join(items), r))
            parts.append(self.leaf(text, "h1" if k == 0 and r.random() < 0.6 else r.choice(LEAVES["article"]), 1))
        if r.random() < 0.35:
            parts.append(self.box(r.choice(["comments", "share", "advert", "form"])))
        inner = "".join(parts)
        if spec == "td|content":
            article = f'<table><tr><td class="content">{inner}</td></tr></table>'
        else:
            article = _wrap(spec, self.neutral(inner, 0.25), r)
        article = self.neutral(article, 0.4)
        after = [self.box(k) for k in ("comments", "share", "sidebar", "advert", "form", "menu", "notice", "footer") if r.random() < 0.42]
        body = self.neutral("".join([*before, article, *after]), 0.2)
        opening = r.choice(["<body>", "<body>", f'<body class="{self.invented()}">', ""])
        x = blocks_of(f"<!DOCTYPE html><html><head><title>x</title></head>{opening}{body}")
        y = [int(2 * t.count(MARKS[1]) > t.count(MARKS[0]) + t.count(MARKS[1])) for t in x.texts]  # inline neighbours share a block
        x.texts = [t.replace(MARKS[0], "").replace(MARKS[1], "") or "." for t in x.texts]
        return x, y


def training_pages(html: str, key: int, layouts: int) -> list[tuple[Blocks, list[int]]]:
    """A page of the sample with weak labels, and its layouts with known ones."""
    b = blocks_of(html)
    labels = {p: weak_label(b.bits[p]) for p in set(b.paths)}
    y = [int(labels[p]) for p in b.paths]
    at = key % max(1, len(y) - SAMPLE_BLOCKS + 1)
    cut = slice(at, at + SAMPLE_BLOCKS)
    b = Blocks(b.texts[cut], b.paths[cut], b.linked[cut], b.bits)
    y = y[cut]
    out = [(b, y)] if 0 < sum(y) < len(y) else []
    if not sum(y):  # no telling elements: texts that look like sentences will do for the layouts
        y = [int(len(t) >= 80 and 3 * k < len(t)) for t, k in zip(b.texts, b.linked)]
    good, bad = [t for t, k in zip(b.texts, y) if k], [t for t, k in zip(b.texts, y) if not k]
    for v in range(layouts):
        out.append(_Layout(good, bad, key * 1009 + v).page())
    return out


# --- inputs -----------------------------------------------------------------------------------


@dataclass
class Inputs:
    """Of the blocks of several pages: path of each, bits of the paths, word buckets with their
    borders, numbers; and blocks of each page."""

    path: np.ndarray
    bits: np.ndarray
    words: np.ndarray
    border: np.ndarray
    numbers: np.ndarray
    each: np.ndarray

    def rows(self, at: np.ndarray) -> np.ndarray:
        """Dense inputs of these blocks."""
        out = np.zeros((len(at), INPUTS), dtype=np.float32)
        paths, own = np.unique(self.path[at], return_inverse=True)
        out[:, :PATH_BITS] = np.unpackbits(self.bits[paths], axis=1, bitorder="little")[own]
        n = self.border[at + 1] - self.border[at]
        place = np.repeat(self.border[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        count = np.bincount(np.repeat(np.arange(len(at)), n) * WORD_BUCKETS + self.words[place], minlength=len(at) * WORD_BUCKETS).reshape(len(at), -1)
        out[:, PATH_BITS:-NUMBERS] = count / np.maximum(np.sqrt((count.astype(float) ** 2).sum(axis=1)), 1)[:, None]
        out[:, -NUMBERS:] = self.numbers[at]
        return out


def inputs_of(pages: list[Blocks]) -> Inputs:
    path, bits, words, border, numbers, shift = [], [], bytearray(), [0], [], 0
    for b in pages:
        path += [p + shift for p in b.paths]
        bits += b.bits
        shift += len(b.bits)
        for i, (t, linked) in enumerate(zip(b.texts, b.linked)):
            own = t.encode("utf-8", "replace").lower().split()
            words += bytes([zlib.crc32(w) % WORD_BUCKETS for w in own])
            border.append(len(words))
            size = len(t)
            marks = sum(map(t.count, ".,;:!?"))
            numbers.append((np.log1p(size) / 8, np.log1p(len(own)) / 6, linked / size, marks / size * 10, t[-1] in ".!?", t[0].isupper(), sum(map(t.count, "0123456789|/@")) / size * 5, i / len(b.texts), size / len(own) / 20))
    raw = b"".join(v.to_bytes(PATH_BITS // 8, "little") for v in bits)
    return Inputs(
        np.array(path, dtype=np.int64),
        np.frombuffer(raw, dtype=np.uint8).reshape(-1, PATH_BITS // 8),
        np.frombuffer(bytes(words), dtype=np.uint8),
        np.array(border, dtype=np.int64),
        np.array(numbers, dtype=np.float32).reshape(-1, NUMBERS),
        np.array([len(b.texts) for b in pages], dtype=np.int64),
    )


# --- the network --------------------------------------------------------------------------------


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Labeller:
    """Weights of both directions: inputs, state, constant; and of the answer."""

    w: np.ndarray  # 2, INPUTS, 4 * HIDDEN: in, forget, out, new
    u: np.ndarray  # 2, HIDDEN, 4 * HIDDEN
    b: np.ndarray  # 2, 4 * HIDDEN
    v: np.ndarray  # 2 * HIDDEN
    c: np.ndarray  # 1

    @staticmethod
    def fresh(seed: int = 7) -> Labeller:
        g = np.random.default_rng(seed)
        b = np.zeros((2, 4 * HIDDEN), dtype=np.float32)
        b[:, HIDDEN : 2 * HIDDEN] = 1
        draw = lambda *shape, s: g.normal(0, s, shape).astype(np.float32)
        return Labeller(draw(2, INPUTS, 4 * HIDDEN, s=0.1), draw(2, HIDDEN, 4 * HIDDEN, s=HIDDEN**-0.5), b, draw(2 * HIDDEN, s=HIDDEN**-0.5), np.zeros(1, dtype=np.float32))

    def probabilities(self, x: Inputs) -> np.ndarray:
        """Of main text, for every block; pages side by side, each step one block of all of them."""
        first, order = np.cumsum(x.each) - x.each, np.argsort(-x.each, kind="stable")
        long = x.each[order]
        top, answer = int(long[0]) if len(long) else 0, np.full(len(x.path), self.c[0], dtype=np.float32)
        for way in (0, 1):
            h, c = (np.zeros((len(long), HIDDEN), dtype=np.float32) for _ in range(2))
            out = self.v[way * HIDDEN : (way + 1) * HIDDEN]
            for begin in range(0, top, STEPS):
                steps = range(begin, min(top, begin + STEPS))
                active = [int(np.searchsorted(-long, -s, side="left")) for s in steps]  # pages with more than s blocks
                place = [first[order[:n]] + (s if way == 0 else long[:n] - 1 - s) for s, n in zip(steps, active)]
                flat = np.concatenate(place)
                gates = np.vstack([x.rows(flat[i : i + 4096]) @ self.w[way] for i in range(0, len(flat), 4096)]) + self.b[way]
                at = 0
                for p, n in zip(place, active):
                    h[:n], c[:n] = _step(gates[at : at + n] + h[:n] @ self.u[way], c[:n])[:2]
                    answer[p] += h[:n] @ out
                    at += n
        return _sigmoid(answer)


def _step(z: np.ndarray, c: np.ndarray):
    """State, memory and the gates after one block."""
    k = HIDDEN
    s = _sigmoid(z[:, : 3 * k])
    new = np.tanh(z[:, 3 * k :])
    c2 = s[:, k : 2 * k] * c + s[:, :k] * new
    t = np.tanh(c2)
    return s[:, 2 * k :] * t, c2, s, new, t


def _gradients(m: Labeller, dense: np.ndarray, each: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean log loss over the blocks of some pages."""
    k, n, top = HIDDEN, len(each), int(each.max())
    first = np.cumsum(each) - each
    s = np.arange(top)
    mask = (s[:, None] < each[None, :]).astype(np.float32)[..., None]
    place = [first[None, :] + np.minimum(s[:, None], each - 1), first[None, :] + np.maximum(each[None, :] - 1 - s[:, None], 0)]
    kept, hidden = [], np.zeros((len(dense), 2 * k), dtype=np.float32)
    for way in (0, 1):
        gates = dense @ m.w[way] + m.b[way]
        h, c = (np.zeros((n, k), dtype=np.float32) for _ in range(2))
        steps = []
        for i in range(top):
            h0, c0 = h, c
            h1, c1, sig, new, t = _step(gates[place[way][i]] + h0 @ m.u[way], c0)
            h, c = mask[i] * h1 + (1 - mask[i]) * h0, mask[i] * c1 + (1 - mask[i]) * c0
            on = mask[i, :, 0] > 0
            hidden[place[way][i][on], way * k : (way + 1) * k] = h[on]
            steps.append((h0, c0, sig, new, t))
        kept.append(steps)
    delta = ((_sigmoid(hidden @ m.v + m.c[0]) - y) / len(y)).astype(np.float32)
    g = {"v": hidden.T @ delta, "c": np.array([delta.sum()], dtype=np.float32), "w": np.zeros_like(m.w), "u": np.zeros_like(m.u), "b": np.zeros_like(m.b)}
    for way in (0, 1):
        dz_all = np.zeros((len(dense), 4 * k), dtype=np.float32)
        dh, dc = (np.zeros((n, k), dtype=np.float32) for _ in range(2))
        out = m.v[way * k : (way + 1) * k]
        for i in range(top - 1, -1, -1):
            h0, c0, sig, new, t = kept[way][i]
            into, forget, gate = sig[:, :k], sig[:, k : 2 * k], sig[:, 2 * k :]
            dh1 = (dh + delta[place[way][i]][:, None] * out) * mask[i]
            dc1 = dc * mask[i] + dh1 * gate * (1 - t * t)
            dz = np.hstack([dc1 * new * into * (1 - into), dc1 * c0 * forget * (1 - forget), dh1 * t * gate * (1 - gate), dc1 * into * (1 - new * new)])
            on = mask[i, :, 0] > 0
            dz_all[place[way][i][on]] = dz[on]
            g["u"][way] += h0.T @ dz
            dh = dz @ m.u[way].T + dh * (1 - mask[i])
            dc = dc1 * forget + dc * (1 - mask[i])
        g["w"][way], g["b"][way] = dense.T @ dz_all, dz_all.sum(axis=0)
    return g


def train(x: Inputs, y: np.ndarray, seed: int = 7) -> Labeller:
    """Adam over batches of pages of similar length; some path bits are left out of each batch."""
    m, g = Labeller.fresh(seed), np.random.default_rng(seed)
    first = np.cumsum(x.each) - x.each
    usable = np.flatnonzero(x.each > 0)
    order = usable[np.argsort(x.each[usable], kind="stable")]
    batches = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
    moments = {n: (np.zeros_like(getattr(m, n)), np.zeros_like(getattr(m, n))) for n in ("w", "u", "b", "v", "c")}
    step = 0
    for _ in range(EPOCHS):
        for k in g.permutation(len(batches)):
            pages = batches[k]
            at = np.concatenate([np.arange(first[p], first[p] + x.each[p]) for p in pages])
            dense = x.rows(at)
            dense[:, : PATH_BITS + WORD_BUCKETS] *= (g.random(PATH_BITS + WORD_BUCKETS) >= DROPPED).astype(np.float32)
            step += 1
            for name, d in _gradients(m, dense, x.each[pages], y[at]).items():
                p, (a, b) = getattr(m, name), moments[name]
                d = np.clip(d, -1, 1)
                a *= 0.9
                a += 0.1 * d
                b *= 0.999
                b += 0.001 * d * d
                p *= 1 - RIDGE
                p -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return m


# --- over tables -------------------------------------------------------------------------------


def fit(pages: DataFrame, sample: int = SAMPLE_PAGES) -> Labeller:
    """The network from a bounded sample of pages; laid out and read in tasks, fitted on the driver."""
    few = pick(pages, "page_id", "html", types={"html": StringType()}).filter(F.col("page_id").isNotNull() & (F.length("html") > 0))
    # the sample is told by ids first, so that no page is sorted; of rows with one id the smallest page
    ids = few.select("page_id", F.xxhash64("page_id").alias("key")).distinct().orderBy("key", "page_id").limit(sample)
    layouts = -(-LAYOUTS // max(1, ids.count()))
    few = few.join(F.broadcast(ids), "page_id").groupBy("page_id", "key").agg(F.min("html").alias("html"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batch_slices(batches, 2):
            for page_id, key, html in zip(*(b.column(i).to_pylist() for i in range(3))):
                made = training_pages(html, key & (2**63 - 1), layouts)
                x = inputs_of([blocks for blocks, _ in made])
                if not len(x.path):
                    continue
                parts = (x.path, x.bits, x.words, x.border, x.numbers, x.each, np.concatenate([y for _, y in made]).astype(np.int8))
                yield pa.RecordBatch.from_arrays([pa.array([page_id]), *(pa.array([p.tobytes()], pa.binary()) for p in parts)], names=["page_id", *NAMES])

    # at most `sample` pages of SAMPLE_BLOCKS blocks, laid out LAYOUTS times in all
    rows = few.mapInArrow(read, "page_id long, " + ", ".join(f"{n} binary" for n in NAMES)).collect()
    read_ = [[np.frombuffer(r[n], dtype=t) for n, t in zip(NAMES, (np.int64, np.uint8, np.uint8, np.int64, np.float32, np.int64, np.int8))] for r in sorted(rows, key=lambda r: r.page_id)]
    if not read_:  # nothing to learn from: layouts of own phrases alone
        made = [p for k in range(40) for p in training_pages("", k, LAYOUTS // 40)]
        x = inputs_of([blocks for blocks, _ in made])
        return train(x, np.concatenate([y for _, y in made]).astype(np.float32))
    path, bits, words, border, numbers, each, y = zip(*read_)
    bits = [v.reshape(-1, PATH_BITS // 8) for v in bits]
    paths, ends = np.cumsum([0, *map(len, bits)]), np.cumsum([0, *map(len, words)])
    x = Inputs(
        np.concatenate([p + s for p, s in zip(path, paths)]),
        np.vstack(bits),
        np.concatenate(words),
        np.concatenate([np.zeros(1, dtype=np.int64), *(v[1:] + s for v, s in zip(border, ends))]),
        np.vstack([v.reshape(-1, NUMBERS) for v in numbers]),
        np.concatenate(each),
    )
    return train(x, np.concatenate(y).astype(np.float32))


NAMES = ("path", "bits", "words", "border", "numbers", "each", "y")


def main_text(pages: list[Blocks], labeller: Labeller) -> list[tuple[str, int]]:
    """Text, and blocks kept, of each page."""
    x = inputs_of(pages)
    good, at, out = labeller.probabilities(x) >= THRESHOLD, 0, []
    for b in pages:
        keep = np.flatnonzero(good[at : at + len(b.texts)]).tolist()
        at += len(b.texts)
        out.append((" ".join([b.texts[i] for i in keep]), len(keep)))
    return out


def extract(pages: DataFrame, labeller: Labeller) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_kept of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batch_slices(batches, 2, 1 << 20):
            read = [blocks_of(t or "") for t in b.column(2).to_pylist()]
            found = main_text(read, labeller)
            cols = [b.column(0), b.column(1), pa.array([t for t, _ in found], pa.string()), pa.array([len(t) for t, _ in found], pa.int64()), pa.array([len(r.texts) for r in read], pa.int64()), pa.array([k for _, k in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"])
        give_back()

    d = pick(pages, "page_id", "url", "html", types={"html": StringType()})
    return d.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long, n_kept long")


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages, fit(pages))


QUERIES = {"op11_html_extraction": op11_html_extraction}
#: SQL has no trained network.
ORACLES: dict[str, str] = {}
