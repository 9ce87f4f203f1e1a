"""Main text of HTML pages by a linear-chain conditional random field over leaf blocks.

A page becomes the sequence of its leaf blocks (text runs between block-level
tags). Each block has binary features of its ancestors (tags, class and id
words) and of its text; the field scores whole label sequences, was trained by
maximum likelihood on the labelled pages of ``labelled_pages`` and is decoded by Viterbi.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealbook.llm.labelled_pages import LABEL_ATTRIBUTE, labelled_pages

#: Elements whose content is never text of the page.
SKIPPED = {"script", "style", "head", "title", "template", "noscript", "svg", "math", "iframe", "object", "canvas",
           "audio", "video", "select", "textarea"}
#: All that may stand in a head; any other start tag or text ends one without an end tag.
HEAD_CONTENT = {"base", "basefont", "bgsound", "head", "html", "link", "meta", "title", "noscript", "noframes", "style",
                "script", "template"}
#: Elements inside a block; all others end the block before and after them.
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font",
          "i", "img", "ins", "kbd", "label", "mark", "nobr", "q", "rp", "rt", "ruby", "s", "samp", "small", "span",
          "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "input"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements of other vocabularies that stand within a line and may close themselves; their content is skipped too.
FOREIGN = {"svg", "math"}
#: A start tag that ends an open svg or math (unless html is nested in it by a foreignobject).
BREAKOUT = {"article", "aside", "blockquote", "body", "center", "dd", "div", "dl", "dt", "footer", "h1", "h2", "h3",
            "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
#: All that may stand in a select; another start tag ends one without an end tag.
SELECT_CONTENT = {"option", "optgroup", "hr", "script", "template", "select"}
#: A start tag of the key closes an open element of the values.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
#: An implied end does not reach out of these.
SCOPES = {"ul", "ol", "table", "div", "section", "article", "body", "dl"}
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

TRAIN_PAGES, TRAIN_SEED = 900, 11
STEPS, RATE, PENALTY = 250, 0.1, 3e-4


class Blocks(HTMLParser):
    """Collects a page's leaf blocks: (path, text, characters within links, label).

    Labels are those of the training pages; without ``labelled`` all are 0.
    """

    def __init__(self, labelled: bool = True):
        super().__init__(convert_charrefs=True)
        self.labelled = labelled

    def read(self, html: str) -> list[tuple[tuple, str, int, int]]:
        self.reset()
        self.stack: list[tuple[str, str, int]] = []  # tag, class and id words, label
        self.skip = self.links = 0
        self.text: list[str] = []
        self.linked = 0
        self.path: tuple | None = None
        self.blocks: list[tuple[tuple, str, int, int]] = []
        self.label = 0
        try:
            self.feed(html)
            self.close()
        except (AssertionError, ValueError, IndexError):
            pass  # the parser gives up on this markup: the blocks read so far stay
        self.flush()
        return self.blocks

    def flush(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                self.blocks.append((self.path, text, self.linked, self.label))
            self.text, self.linked, self.path = [], 0, None

    def pop_to(self, at: int) -> None:
        for tag, _, _ in self.stack[at:]:
            self.skip -= tag in SKIPPED
            self.links -= tag == "a"
        del self.stack[at:]

    def end_head(self) -> None:
        if self.stack and self.stack[-1][0] == "head":
            self.pop_to(len(self.stack) - 1)

    def parse_marked_section(self, i, report=1):
        # Browsers read <![ ... > as a comment, whatever stands in it.
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else len(self.rawdata)

    def end_skipped(self, tag) -> None:
        """Ends an open select, svg or math in which the start tag cannot stand."""
        names = [e[0] for e in self.stack]
        if "select" in names and tag not in SELECT_CONTENT:
            self.pop_to(names.index("select"))
        elif tag in BREAKOUT and "foreignobject" not in names:
            at = next((i for i, name in enumerate(names) if name in FOREIGN), None)
            if at is not None:
                self.pop_to(at)

    def handle_starttag(self, tag, attrs):
        if self.skip:
            self.end_skipped(tag)
        if tag not in HEAD_CONTENT:
            self.end_head()
        if tag == "body" and self.skip:  # a head without an end tag
            self.pop_to(next(i for i, e in enumerate(self.stack) if e[0] in SKIPPED))
        if tag not in INLINE and tag not in FOREIGN and not any(e[0] in FOREIGN for e in self.stack):
            self.flush()
            for i in range(len(self.stack) - 1, -1, -1):
                name = self.stack[i][0]
                if name == "p" or name in CLOSES.get(tag, ()):
                    self.pop_to(i)
                    break
                if name in SCOPES or name in SKIPPED:
                    break
        elif tag == "br" and self.text:
            self.text.append(" ")
        if tag in VOID:
            return
        words, label = "", self.stack[-1][2] if self.stack else 0
        for key, value in attrs:
            if key in ("class", "id", "role") and value:
                words += " " + value
            elif self.labelled and key == LABEL_ATTRIBUTE:
                label = int(value == "1")
        self.stack.append((tag, words, label))
        self.skip += tag in SKIPPED
        self.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        if tag in FOREIGN:
            return
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in SKIPPED:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        names = [e[0] for e in self.stack]
        inside = next((i for i, name in enumerate(names) if name in FOREIGN), len(names))
        if tag in names[inside:] or inside < len(names) and tag not in names[:inside]:
            pass  # within an svg or math: the block around it goes on
        elif tag not in INLINE:
            self.flush()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self.pop_to(i)
                return
            if tag in INLINE and self.stack[i][0] not in INLINE:
                return

    def handle_data(self, data):
        if data.strip():
            self.end_head()
        if self.skip:
            return
        if self.path is None:
            if not data.strip():
                return
            self.path = tuple((tag, words) for tag, words, _ in self.stack)
            self.label = self.stack[-1][2] if self.stack else 0
        self.text.append(data)
        if self.links:
            self.linked += len(data)

    def unknown_decl(self, data):
        pass


def path_features(path: tuple) -> list[str]:
    """Features of a block's ancestors."""
    out = set()
    block = [tag for tag, _ in path if tag not in INLINE]
    out.add("leaf=" + (block[-1] if block else ""))
    out.add("above=" + (block[-2] if len(block) > 1 else ""))
    for tag, words in path:
        out.add("in=" + tag)
        for word in _WORD.findall(_CAMEL.sub(" ", words).lower()):
            out.add("word=" + word)
    return sorted(out)


def text_features(text: str, linked: int) -> list[str]:
    """Features of a block's text."""
    n = len(text)
    words = text.count(" ") + 1
    out = [f"length={min(9, n.bit_length())}", f"links={min(3, 4 * linked // max(1, n))}",
           f"words={'1' if words == 1 else '2-3' if words < 4 else '4-9' if words < 10 else '10-24' if words < 25 else '25+'}"]
    if text[-1] in ".!?:;\"'»”…":
        out.append("closed")
    if "," in text or ". " in text:
        out.append("clauses")
    if "©" in text or "(c)" in text[:40].lower():
        out.append("copyright")
    if any(c.isdigit() for c in text[:60]):
        out.append("digit")
    return out


def _forward(score: np.ndarray, lens: np.ndarray, trans: np.ndarray, start: np.ndarray):
    """Log forward and backward sums of padded sequences of two labels; score[..., 1] is label 1's, label 0 has 0."""
    pages, most = score.shape[:2]
    alpha = np.empty((pages, most, 2))
    beta = np.zeros((pages, most, 2))
    alpha[:, 0] = start + score[:, 0]
    for t in range(1, most):
        alpha[:, t] = np.logaddexp.reduce(alpha[:, t - 1, :, None] + trans, axis=1) + score[:, t]
    for t in range(most - 2, -1, -1):
        step = np.logaddexp.reduce(trans + (score[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
        beta[:, t] = np.where((t + 1 < lens)[:, None], step, 0.0)
    total = np.logaddexp.reduce(alpha[np.arange(pages), lens - 1], axis=1)
    return alpha, beta, total


class Field:
    """Weights of the features for label 1, of label pairs and of the first label."""

    def __init__(self, names: list[str]):
        self.index = {n: i for i, n in enumerate(names)}
        self.weights = np.zeros(len(names))
        self.trans, self.start = np.zeros((2, 2)), np.zeros(2)
        self._paths: dict[tuple, float] = {}

    def fit(self, pages: list[list[tuple[list[int], int]]]) -> None:
        """Maximum likelihood with a small quadratic penalty, by Adam on the exact gradient."""
        lens = np.array([len(p) for p in pages])
        most = int(lens.max())
        y = np.zeros((len(pages), most), dtype=np.int64)
        real = np.arange(most) < lens[:, None]
        at, feat = [], []
        for i, page in enumerate(pages):
            for t, (features, label) in enumerate(page):
                y[i, t] = label
                at += [i * most + t] * len(features)
                feat += features
        at, feat = np.array(at), np.array(feat)
        m = [np.zeros_like(x) for x in (self.weights, self.trans, self.start)]
        v = [np.zeros_like(x) for x in (self.weights, self.trans, self.start)]
        both = real[:, 1:]
        for step in range(1, STEPS + 1):
            score = np.zeros((len(pages), most, 2))
            score[:, :, 1] = np.bincount(at, weights=self.weights[feat], minlength=y.size).reshape(y.shape)
            alpha, beta, total = _forward(score, lens, self.trans, self.start)
            p1 = np.exp(alpha[:, :, 1] + beta[:, :, 1] - total[:, None])
            error = np.where(real, p1 - y, 0.0)
            pair = np.exp(alpha[:, :-1, :, None] + self.trans + (score[:, 1:] + beta[:, 1:])[:, :, None, :]
                          - total[:, None, None, None]) * both[:, :, None, None]
            seen = np.zeros((2, 2))
            np.add.at(seen, (y[:, :-1][both], y[:, 1:][both]), 1)
            first = np.stack((1 - p1[:, 0], p1[:, 0]), axis=1) - np.eye(2)[y[:, 0]]
            grads = (np.bincount(feat, weights=error.ravel()[at], minlength=self.weights.size),
                     pair.sum(axis=(0, 1)) - seen, first.sum(axis=0))
            for x, g, a, b in zip((self.weights, self.trans, self.start), grads, m, v):
                g = g / len(pages) + PENALTY * x
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                x -= RATE * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.999 ** step)) + 1e-8)

    def score(self, path: tuple, text: str, linked: int) -> float:
        above = self._paths.get(path)
        if above is None:
            if len(self._paths) > 50_000:
                self._paths.clear()
            above = self._paths[path] = sum(
                self.weights[self.index[f]] for f in path_features(path) if f in self.index)
        return above + sum(self.weights[self.index[f]] for f in text_features(text, linked) if f in self.index)

    def decode(self, scores: list[float]) -> list[int]:
        """Viterbi: the label sequence of the highest total score."""
        (t00, t01), (t10, t11) = self.trans.tolist()
        a, b = self.start.tolist()
        back = []
        b += scores[0]
        for s in scores[1:]:
            from0, from1 = (0 if a + t00 >= b + t10 else 1), (0 if a + t01 >= b + t11 else 1)
            back.append((from0, from1))
            a, b = max(a + t00, b + t10), max(a + t01, b + t11) + s
        label = int(b > a)
        out = [label]
        for pointers in reversed(back):
            label = pointers[label]
            out.append(label)
        return out[::-1]


@lru_cache(maxsize=1)
def train(pages: int = TRAIN_PAGES, seed: int = TRAIN_SEED) -> Field:
    reader = Blocks()
    parsed = [reader.read(html) for html in labelled_pages(pages, seed)]
    described = [[(path_features(p) + text_features(t, k), y) for p, t, k, y in page] for page in parsed if page]
    counts: dict[str, int] = {}
    for page in described:
        for features, _ in page:
            for f in features:
                counts[f] = counts.get(f, 0) + 1
    field = Field(sorted(f for f, n in counts.items() if n >= 3))
    field.fit([[([field.index[f] for f in features if f in field.index], y) for features, y in page]
               for page in described])
    return field


def main_text(html: str | None, field: Field, reader: Blocks) -> str:
    """The blocks of label 1 in page order, joined by two newlines."""
    blocks = reader.read(html) if html else []
    if not blocks:
        return ""
    labels = field.decode([field.score(path, text, linked) for path, text, linked, _ in blocks])
    return "\n\n".join(text for (_, text, _, _), label in zip(blocks, labels) if label)


def extract_main_text(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """Per page: page_id, url, text (main text, empty if none) and n_chars (its code points).

    Reads the whole html; a null or empty one, or one without main blocks,
    gives an empty text. Character references are decoded, white space within a
    block becomes one space, blocks are trimmed. Broken or cut-off markup is
    read as far as it goes. Repeated rows and null ids keep a row each. Other
    columns are not read. No page fails the query: markup that the parser gives
    up on is read up to there.
    """
    field = field or train()

    @F.pandas_udf("string")
    def extract(htmls: pd.Series) -> pd.Series:
        reader = Blocks(labelled=False)
        return pd.Series([main_text(h, field, reader) for h in htmls], dtype=object)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", extract("html").alias("text"))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
