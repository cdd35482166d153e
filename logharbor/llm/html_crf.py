"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks."""

from __future__ import annotations

import html as entities
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logharbor.llm.common import small_batches
from logharbor.llm.labelled_pages import MAIN, labelled_pages

# Tags by their part in a page.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose content is no markup, and those left out with the markup in them.
RAW = frozenset("script style iframe textarea title noframes".split())
SKIPPED = frozenset("template noscript svg math object select button canvas audio video".split())
# An opening tag of the key ends an open one of the values, unless one of the last set stands between.
ENDS = {
    **{t: ("p",) for t in "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()},
    "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"),
}
WALLS = frozenset("html body table ul ol dl article section div main aside header footer nav form blockquote td th".split())
# Parts of class names, ids and roles, by what they say of a block.
HINTS = (
    ("ad", r"\bads?\b|advert|sponsor|promo|banner-ad|\bdfp\b|adsbygoogle"),
    ("comment", r"comment|repl(?:y|ies)|discuss|disqus|respond"),
    ("side", r"side|related|widget|recommend|popular|more-|teaser|trending"),
    ("nav", r"nav|menu|breadcrumb|pagination|pager|\btabs?\b|toolbar|skip"),
    ("foot", r"foot|copyright|legal|contentinfo|colophon"),
    ("head", r"masthead|(?<!sub)header|\bbanner\b|\btop\b|logo"),
    ("notice", r"cookie|notice|consent|alert|modal|popup|gdpr|dialog|toast"),
    ("share", r"share|social|newsletter|subscri|login|signup|sign-up|search|form"),
    ("body", r"article|content(?!info)|post(?!er)|entry|story|body|main"),
)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S)
_RAW_END = {n: re.compile(rf"</{n}(?=[\s/>])", re.I | re.A) for n in RAW}
_SKIPPED_TAG = {n: re.compile(rf"<(/?){n}(?=[\s/>])([^>]*)>", re.I | re.A) for n in SKIPPED}
# Where an element to be left out ends that has no end tag.
_STRUCTURE = re.compile(
    r"</?(?:address|article|aside|blockquote|body|d[dlt]|div|fieldset|figure|footer|form|h[1-6r]|head|header|html|li|main|nav|ol|p|pre|section|table|t[dhr]|ul)(?=[\s/>])",
    re.I | re.A)
_MARKS = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACE = re.compile(r"\s+")
_HINTS = [(name, re.compile(pattern, re.I)) for name, pattern in HINTS]
_SENTENCE_END = (".", "!", "?", ":", ";", "\"", "”", "…", "。")
EPOCHS, RATE, DECAY = 25, 0.5, 1e-4


@lru_cache(maxsize=4096)
def _hints(attributes: str) -> tuple[str, ...]:
    marks = " ".join(a or b or c for a, b, c in _MARKS.findall(attributes))
    return tuple(name for name, pattern in _HINTS if pattern.search(marks)) if marks else ()


def _ends(page: str, name: str) -> dict[int, int]:
    """Begin of each opening tag of the name, and the end of the closing tag that goes with it."""
    out, opened = {}, []
    for found in _SKIPPED_TAG[name].finditer(page):
        if not found[1]:
            if not found[2].endswith("/"):
                opened.append(found.start())
        elif opened:
            out[opened.pop()] = found.end()
    return out


def blocks(page: str) -> list[tuple[str, tuple, int]]:
    """(text, open tags with hints, characters inside links) of each leaf block, in page order.

    A block is the text between two block-level tags. Character references are
    decoded, white space runs are one space, ends are trimmed, empty blocks are
    left out. Scripts, styles, forms' fields and markup are no text. Open tags
    at the end of the page, stray closing tags and broken tags do no harm: of
    elements that are left out, only those whose content is no markup (``RAW``)
    run to the end of the page without an end tag, others to the next tag of a block.
    """
    out: list[tuple[str, tuple, int]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    pieces: list[str] = []
    linked, in_link, at = 0, 0, 0

    def take(text: str) -> None:
        nonlocal linked
        if text:
            pieces.append(text)
            if in_link:
                linked += len(text.strip())

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = "".join(pieces)
            text = _SPACE.sub(" ", entities.unescape(text) if "&" in text else text).strip()
            if text:
                out.append((text, tuple(x for x in stack if x[0] not in INLINE), min(linked, len(text))))
            pieces.clear()
        linked = 0

    ends: dict[str, dict[int, int]] = {}
    while True:
        found = _TOKEN.search(page, at)
        if found is None:
            take(page[at:])
            break
        take(page[at:found.start()])
        at = found.end()
        close, name = found[1], found[2] or found[4]
        if close:
            close = close.lower()
            if close == "a":
                in_link = max(0, in_link - 1)
            if close not in INLINE:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == close:
                    # An inline tag that ends does not end the blocks opened within it.
                    if close in INLINE:
                        del stack[i]
                    else:
                        del stack[i:]
                        in_link = sum(x[0] == "a" for x in stack)
                    break
                if close not in INLINE and stack[i][0] in ("body", "html"):
                    break
        elif name:
            name, attributes = name.lower(), found[3] if found[2] else found[5]
            if name == "br":
                pieces.append(" ")
                continue
            if name not in INLINE:
                flush()
            # The end tag of a head is optional; what is no text in it is left out by itself.
            if name in VOID or name == "head" or attributes.endswith("/") and (name in RAW or name in SKIPPED):
                continue
            if name in RAW:
                end = _RAW_END[name].search(page, at)
                stop = page.find(">", end.end()) if end else -1
                at = stop + 1 if stop >= 0 else len(page)
                continue
            if name in SKIPPED:
                if name not in ends:
                    ends[name] = _ends(page, name)
                stop = ends[name].get(found.start())
                if stop is None:
                    end = _STRUCTURE.search(page, at)
                    stop = end.start() if end else len(page)
                at = max(at, stop)
                continue
            ended = ENDS.get(name)
            if ended:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in ended:
                        del stack[i:]
                        in_link = sum(x[0] == "a" for x in stack)
                        if name == "p" or "p" in ended and len(ended) == 1:
                            break
                    elif stack[i][0] in WALLS:
                        break
            if name == "a":
                in_link += 1
            stack.append((name, _hints(attributes) if attributes else ()))
    flush()
    return out


@lru_cache(maxsize=8192)
def _chain_features(chain: tuple) -> tuple[str, ...]:
    """Features of the open tags: each tag, each hint, the innermost two, and hints inside the innermost body part."""
    names = [n for n, _ in chain]
    found = {f"in:{n}" for n in names} | {f"hint:{h}" for _, hints in chain for h in hints}
    found.add(f"leaf:{names[-1] if names else ''}")
    found.add("path:" + ">".join(names[-2:]))
    for n, hints in reversed(chain):
        if hints or n in ("article", "main", "nav", "aside", "footer", "header", "form", "section"):
            found.add(f"near:{hints[0] if hints else n}")
            break
    return tuple(sorted(found))


def _text_features(text: str, linked: int) -> tuple[str, ...]:
    n = len(text)
    return (
        f"length:{min(n.bit_length(), 10)}", f"linked:{4 * linked // max(n, 1)}", f"ends:{text.endswith(_SENTENCE_END)}",
        f"commas:{min(text.count(','), 3)}", f"legal:{'©' in text[:40] or '(c)' in text[:40].lower()}",
    )


class BlockTagger:
    """Weights of block features and of neighbouring labels; pickles to a few kilobytes."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.weights = np.zeros(0)
        self.change = np.zeros((2, 2))
        self.begin = np.zeros(2)
        self.chains: dict[tuple, float] = {}

    def features(self, block) -> list[str]:
        text, chain, linked = block
        return ["any", *_chain_features(chain), *_text_features(text, linked)]

    def fit(self, pages: list[tuple[str, list[tuple[str, int]]]], epochs: int = EPOCHS) -> BlockTagger:
        """Gradient ascent on the log likelihood of the labels, by forward and backward sums."""
        sequences = []
        for page, labels in pages:
            found = blocks(page)
            assert [b[0] for b in found] == [" ".join(t.split()) for t, _ in labels], "labels and blocks differ"
            ids = [[self.index.setdefault(f, len(self.index)) for f in self.features(b)] for b in found]
            if ids:
                sequences.append((ids, np.array([y for _, y in labels])))
        self.weights = np.zeros(len(self.index))
        squares = [np.full_like(x, 1e-6) for x in (self.weights, self.change, self.begin)]
        for _ in range(epochs):
            slopes = [-DECAY * len(sequences) * x for x in (self.weights, self.change, self.begin)]
            for ids, labels in sequences:
                emit = np.zeros((len(ids), 2))
                emit[:, MAIN] = [self.weights[i].sum() for i in ids]
                forward, backward = emit.copy(), np.zeros_like(emit)
                forward[0] += self.begin
                for t in range(1, len(ids)):
                    forward[t] += np.logaddexp.reduce(forward[t - 1][:, None] + self.change, axis=0)
                for t in range(len(ids) - 2, -1, -1):
                    backward[t] = np.logaddexp.reduce(self.change + (emit[t + 1] + backward[t + 1])[None], axis=1)
                total = np.logaddexp.reduce(forward[-1])
                off = (labels == MAIN) - np.exp(forward + backward - total)[:, MAIN]
                for i, d in zip(ids, off, strict=True):
                    slopes[0][i] += d
                slopes[2] += np.eye(2)[labels[0]] - np.exp(forward[0] + backward[0] - total)
                pairs = forward[:-1, :, None] + self.change[None] + (emit[1:] + backward[1:])[:, None, :] - total
                slopes[1] -= np.exp(pairs).sum(0)
                np.add.at(slopes[1], (labels[:-1], labels[1:]), 1)
            for value, slope, square in zip((self.weights, self.change, self.begin), slopes, squares, strict=True):
                square += slope * slope
                value += RATE * slope / np.sqrt(square)
        return self

    def labels(self, found: list) -> list[int]:
        """Likeliest labels of all blocks together (Viterbi); ties go to the smaller label."""
        if not found:
            return []
        get, weights, emit = self.index.get, self.weights, []
        for text, chain, linked in found:
            if chain not in self.chains:
                if len(self.chains) > 8192:
                    self.chains.clear()
                self.chains[chain] = float(sum(weights[i] for i in map(get, ("any", *_chain_features(chain))) if i is not None))
            emit.append(self.chains[chain] + sum(weights[i] for i in map(get, _text_features(text, linked)) if i is not None))
        (c00, c01), (c10, c11) = self.change.tolist()
        a, b = float(self.begin[0]), float(self.begin[1]) + emit[0]
        back = []
        for e in emit[1:]:
            from_a, from_b = a + c01 > b + c11, a + c00 >= b + c10
            back.append((0 if from_b else 1, 0 if from_a else 1))
            a, b = (a + c00 if from_b else b + c10), (a + c01 if from_a else b + c11) + e
        out = [1 if b > a else 0]
        for step in reversed(back):
            out.append(step[out[-1]])
        return out[::-1]

    def text(self, page: str | None) -> str:
        found = blocks(page or "")
        return "\n\n".join(b[0] for b, y in zip(found, self.labels(found), strict=True) if y == MAIN)


def fitted_tagger(pages: list[tuple[str, list[tuple[str, int]]]] | None = None) -> BlockTagger:
    return BlockTagger().fit(labelled_pages() if pages is None else pages)


def main_texts(pages: DataFrame, tagger: BlockTagger | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page row, from its whole html.

    Blocks labelled as article text are joined by a blank line in page order. Null
    and empty pages, and pages without such blocks, give an empty text. Repeated
    rows give repeated rows; null ids and urls stay null; other columns are not read.
    """
    tagger = fitted_tagger() if tagger is None else tagger

    def rows(batches):
        for batch in batches:
            texts = [tagger.text(h.decode("utf-8", "replace")) for h in batch.column("_html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    small_batches(pages.sparkSession)
    kinds = dict(pages.dtypes)
    html = F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b"")).alias("_html")
    return pages.select("page_id", "url", html).mapInArrow(rows, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
