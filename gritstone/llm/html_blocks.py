"""Main text of web pages by a recurrent block labeller.

A page is cut into its leaf blocks of text in page order. Each block is a vector: its tag path
and the class and id words on it, hashed; its words, hashed; its length, links and punctuation.
A bidirectional LSTM, in numpy, reads the blocks of a page in both directions, so that each is
labelled knowing all others. It is trained on a bounded sample of pages that mark their article
with <article> or <main>; tags are swapped at random for generic ones with telling class names,
so that the labeller also learns pages without those tags.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Pages that the labeller is trained on at most: those whose page_id hashes lowest.
TRAIN_PAGES = 300
PATH, WORDS, EXTRA, HIDDEN = 48, 16, 6, 8
INPUT = PATH + WORDS + EXTRA
#: Blocks of a training page that are learned from at most, and blocks that are labelled at once, unless a page has more.
TRAIN_BLOCKS, TOGETHER = 400, 25_600
_VOID = frozenset("br img hr meta link input source wbr area base col embed track param".split())
_BLOCK = frozenset("address article aside blockquote body button caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split())
_SILENT = frozenset("script style noscript template svg iframe object".split())
#: Fixed lists: tags around what isn't the article, and class words of what is and isn't.
_AROUND = frozenset("nav header footer aside form head menu button select dialog textarea".split())
_ASIDE_WORDS = {
    "nav": "nav menu navbar breadcrumb toolbar", "footer": "footer foot copyright bottom legal", "header": "header masthead top banner", "aside": "sidebar aside related widget promo",
    "ad": "ad ads advert advertisement sponsor sponsored", "notice": "cookie notice consent popup newsletter subscribe", "comments": "comments comment replies discussion respond", "form": "form login search signup",
}
_MAIN_WORDS = ("content", "main", "post", "article", "entry", "story", "body", "text")
_ASIDE = frozenset(w for words in _ASIDE_WORDS.values() for w in words.split())


class _Blocks(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.blocks: list[tuple[list[tuple[str, tuple[str, ...]]], str, int]] = []
        self.held: list[str] = []
        self.linked = 0
        self.silent: int | None = None  # place in the stack of the outermost open silent element

    def flush(self) -> None:
        text = " ".join("".join(self.held).split())
        if text:
            self.blocks.append((list(self.stack), text, self.linked))
        self.held, self.linked = [], 0

    def pop(self, tag: str) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                if self.silent is not None and k <= self.silent:
                    self.silent = None
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "br":
            self.held.append(" ")
        if tag in _VOID:
            return
        if tag in _BLOCK and self.silent is None:  # what is in a silent element neither ends nor closes anything around it
            self.flush()
            tags = [t for t, _ in self.stack]
            if "p" in tags and tag not in ("button", "select", "option"):  # a block ends an open paragraph and the inline tags in it
                self.pop("p")
            if tag in ("li", "td", "tr", "option") and tag in tags and not {"ul", "ol", "table"} & set(tags[len(tags) - tags[::-1].index(tag) :]):
                self.pop(tag)
            if tag == "body":
                self.pop("head")
            if tag == "footer" and "article" in tags and "body" in tags and self.stack[-1][0] == "article" and len(self.blocks) and not any(t == "section" for t in tags):
                self.pop("article")  # left open: a page's footer isn't the article's
        words: tuple[str, ...] = ()
        for name, value in attrs:
            if name in ("class", "id", "role") and value:
                words += tuple(w for w in re.split(r"[^a-z]+", value.lower()) if w)
        if tag in _SILENT and self.silent is None:
            self.silent = len(self.stack)
        self.stack.append((tag, words))

    def handle_endtag(self, tag: str) -> None:
        if tag in _BLOCK and (self.silent is None or any(t == tag for t, _ in self.stack[: self.silent]) and all(t != tag for t, _ in self.stack[self.silent :])):
            self.flush()
        self.pop(tag)

    def handle_data(self, data: str) -> None:
        if self.silent is not None:
            return
        self.held.append(data)
        if any(t == "a" for t, _ in self.stack):
            self.linked += len(data)


def blocks_of(page: str | None) -> list[tuple[list, str, int]]:
    """(path of (tag, class words), text, characters in links) of a page's blocks, in order."""
    p = _Blocks()
    p.feed(page or "")
    p.close()
    p.flush()
    return p.blocks


def weak_label(path: list) -> int | None:
    """1 inside an article or main part and nothing around it, 0 elsewhere; None can't tell."""
    tags = [t for t, _ in path]
    marks = [k for k, t in enumerate(tags) if t in ("article", "main")]
    if any(t in _AROUND or _ASIDE & set(w) for t, w in path):
        return 0
    return 1 if marks else 0


def _disguise(path: list, names: dict[str, tuple[str, tuple[str, ...]]]) -> list:
    return [names.get(t, (t, w)) if not w or t in names else (t, w) for t, w in path]


def _tag_path(element: tuple[str, tuple[str, ...]], around: np.ndarray) -> np.ndarray:
    """Counts of an element's tag and class words, added to those of the elements around it."""
    tag, words = element
    out = around.copy()
    out[zlib.crc32(tag.encode()) % PATH] += 1
    for w in words:
        out[zlib.crc32(b"." + w.encode()) % PATH] += 1.5
    return out


def vectors(blocks: list) -> np.ndarray:
    """A row for each block. Its whole tag path counts; the second and further equals of a path add only their logarithm, so that depth doesn't outweigh names."""
    x = np.zeros((len(blocks), INPUT), np.float32)
    last: list = []
    sums = [np.zeros(PATH, np.float32)]  # of the first 0, 1, ... elements of `last`
    for i, (path, text, linked) in enumerate(blocks):
        same = next((k for k, (a, b) in enumerate(zip(path, last, strict=False)) if a is not b), min(len(path), len(last)))
        del sums[same + 1 :]
        for element in path[same:]:
            sums.append(_tag_path(element, sums[-1]))
        last = path
        x[i, :PATH] = np.where(sums[-1] > 2, 2 + np.log(np.maximum(sums[-1], 2) / 2), sums[-1])
        tokens = text.lower().split()
        for w in tokens:
            x[i, PATH + zlib.crc32(w.encode()) % WORDS] += 1 / (1 + len(tokens))
        k = PATH + WORDS
        x[i, k:] = (np.log1p(len(text)) / 8, linked / max(1, len(text)), text[-1] in ".!?…", text.count(".") / (1 + len(tokens)), i / len(blocks), 1 / (1 + len(path)))
    return x


class Labeller:
    """A bidirectional LSTM with a logistic output for each block."""

    def __init__(self, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        self.w = {}
        for side in "fb":
            self.w["x" + side] = r.normal(0, 0.15, (INPUT, 4 * HIDDEN)).astype(np.float32)
            self.w["h" + side] = r.normal(0, 0.15, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            self.w["c" + side] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(np.float32)
        self.w["o"] = r.normal(0, 0.15, 2 * HIDDEN).astype(np.float32)
        self.w["q"] = np.zeros(1, np.float32)

    @staticmethod
    def _sig(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def _side(self, x: np.ndarray, mask: np.ndarray, side: str, learning: bool = True) -> tuple[np.ndarray, list]:
        pages, steps, _ = x.shape
        z = x @ self.w["x" + side] + self.w["c" + side]
        h = c = np.zeros((pages, HIDDEN), np.float32)
        out, tape = np.zeros((pages, steps, HIDDEN), np.float32), []
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            a = z[:, t] + h @ self.w["h" + side]
            i, f, o = (self._sig(a[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(a[:, 3 * HIDDEN :])
            m = mask[:, t, None]
            new = f * c + i * g
            if learning:
                tape.append((t, h, c, i, f, o, g, np.tanh(new), m))
            c = m * new + (1 - m) * c
            h = m * o * np.tanh(new) + (1 - m) * h
            out[:, t] = h
        return out, tape

    def forward(self, x: np.ndarray, mask: np.ndarray, learning: bool = True) -> tuple[np.ndarray, tuple]:
        (hf, tf), (hb, tb) = self._side(x, mask, "f", learning), self._side(x, mask, "b", learning)
        both = np.concatenate([hf, hb], axis=2)
        return self._sig(both @ self.w["o"] + self.w["q"]), (both, tf, tb)

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, (both, tf, tb) = self.forward(x, mask)
        d = (p - y) * mask / max(1.0, mask.sum())
        grad = {"o": np.einsum("pt,pth->h", d, both), "q": np.array([d.sum()])}
        for side, tape, part in (("f", tf, slice(0, HIDDEN)), ("b", tb, slice(HIDDEN, None))):
            dh_out = d[:, :, None] * self.w["o"][part]
            dz = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            dh = dc = np.zeros((x.shape[0], HIDDEN), np.float32)
            grad["h" + side] = np.zeros_like(self.w["h" + side])
            for t, h, c, i, f, o, g, tanh, m in reversed(tape):
                dh = dh + dh_out[:, t]
                dn = m * dh * o * (1 - tanh**2) + m * dc
                a = np.concatenate([dn * g * i * (1 - i), dn * c * f * (1 - f), m * dh * tanh * o * (1 - o), dn * i * (1 - g**2)], axis=1)
                dz[:, t] = a
                grad["h" + side] += h.T @ a
                dc, dh = dn * f + (1 - m) * dc, a @ self.w["h" + side].T + (1 - m) * dh
            grad["x" + side] = np.einsum("pti,ptk->ik", x, dz)
            grad["c" + side] = dz.sum((0, 1))
        return grad

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], rounds: int = 40, size: int = 50, rate: float = 0.02) -> Labeller:
        r = np.random.default_rng(3)
        m, v, n = {k: np.zeros_like(a) for k, a in self.w.items()}, {k: np.zeros_like(a) for k, a in self.w.items()}, 0
        for _ in range(rounds if pages else 0):
            order = r.permutation(len(pages))
            for lo in range(0, len(order), size):
                x, mask, y = _padded([pages[k] for k in order[lo : lo + size]])
                n += 1
                for k, g in self.gradients(x, mask, y).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] = (self.w[k] - rate * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.999**n)) + 1e-8)).astype(np.float32)
        return self


def _padded(pages: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    steps = max(len(x) for x, _ in pages)
    x, mask, y = np.zeros((len(pages), steps, INPUT), np.float32), np.zeros((len(pages), steps), np.float32), np.zeros((len(pages), steps), np.float32)
    for k, (a, b) in enumerate(pages):
        x[k, : len(a)], mask[k, : len(a)], y[k, : len(b)] = a, 1, b
    return x, mask, y


def loose_label(path: list, text: str, linked: int) -> int:
    """1 for a block that isn't around or beside anything by its tags and class words, nor mostly links: for pages that don't mark their article."""
    return int(not any(t in _AROUND or _ASIDE & set(w) for t, w in path) and 2 * linked < len(text))


def train(pages: list[str]) -> Labeller:
    """A labeller fitted to the pages that mark their article. Without any, one fitted to looser labels; where these don't differ either, one that says of every block what they say."""
    held = [blocks_of(page)[:TRAIN_BLOCKS] for page in pages]
    told = [np.array([weak_label(path) for path, _, _ in blocks], np.float32) for blocks in held]
    if not any(x.sum() and not x.all() for x in told):
        told = [np.array([loose_label(*block) for block in blocks], np.float32) for blocks in held]
    r, wraps = np.random.default_rng(5), np.random.default_rng(6)
    made = []
    for blocks, labels in zip(held, told, strict=True):
        if not labels.sum() or labels.all():
            continue
        made.append((vectors(blocks), labels))
        for _ in range(2):
            names = {t: ("div", (r.choice(words.split()),)) for t, words in _ASIDE_WORDS.items() if r.random() < 0.8}
            names |= {t: ("div", (r.choice(_MAIN_WORDS),)) for t in ("article", "main") if r.random() < 0.8}
            kinds = sorted(_ASIDE_WORDS)
            changed = []
            for path, text, linked in blocks:
                path = _disguise(path, names)
                if path and path[-1][0] == "div" and "ad" in path[-1][1]:
                    path = [*path[:-1], ("div", (r.choice(_ASIDE_WORDS[r.choice(kinds)].split()),))]
                changed.append((path, text, linked))
            made.append((vectors(changed), labels))
        plain = [("div", ())] * int(2 ** wraps.uniform(1, 7))  # the page with its text nested deeper, for pages that nest more than these
        made.append((vectors([([*path[:-1], *plain, *path[-1:]], text, linked) for path, text, linked in blocks]), labels))
    model = Labeller().fit(made)
    if not made:
        model.w = {k: np.zeros_like(v) for k, v in model.w.items()}
        model.w["q"][0] = 1 if all(x.all() for x in told) else -1
    return model


def label(model: Labeller, pages: list[list]) -> list[np.ndarray]:
    """Probability of main text for the blocks of each page, each block read with all others of its page, however many."""
    out = [np.zeros(len(b), np.float32) for b in pages]
    order = sorted((k for k, b in enumerate(pages) if b), key=lambda k: len(pages[k]))
    while order:
        size = 1  # pages of like length, the longest first
        while size < min(64, len(order)) and (size + 1) * len(pages[order[-1]]) <= TOGETHER:
            size += 1
        held, order = order[-size:], order[:-size]
        xs = [vectors(pages[k]) for k in held]
        x, mask, _ = _padded([(own, own[:0, 0]) for own in xs])
        p, _ = model.forward(x, mask, learning=False)
        for k, row in zip(held, p, strict=True):
            out[k] = row[: len(pages[k])]
    return out


def _extract(model: Labeller):  # noqa: ANN202
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                pages = [blocks_of(h.as_py()) for h in part.column("html")]
                texts = ["\n\n".join(text for (_, text, _), p in zip(blocks, probability, strict=True) if p >= 0.5) for blocks, probability in zip(pages, label(model, pages), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(b) for b in pages], pa.int32())], ["page_id", "url", "text", "n_chars", "n_blocks"])

    return extract


def main_text(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks of each row of pages(page_id, url, html).

    text has the blocks labelled as main, white space in each made one space, joined by two line
    ends; it is empty where there is none. Null and empty html have no blocks. Repeated rows and
    null page_ids get a row each; an empty table gives an empty table; other columns are ignored.
    The labeller learns from at most train_pages pages of up to 200,000 characters, and of each
    from the first TRAIN_BLOCKS blocks; every page, however long, is read and labelled whole.
    """
    own = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    sample = own.filter("length(html) between 1 and 200000").orderBy(F.xxhash64("page_id"), "page_id").limit(train_pages).select("html").collect()
    model = train(sorted(r.html for r in sample))
    return own.mapInArrow(_extract(model), "page_id bigint, url string, text string, n_chars bigint, n_blocks int")


def op6_block_labeller(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
