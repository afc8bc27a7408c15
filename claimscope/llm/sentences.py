"""Sentence boundaries across languages and scripts, by a maximum-entropy classifier of candidate boundaries.

Layout comes first: blank lines end a sentence for certain, so do list items and line breaks before which the next
word would have fitted; other line breaks are white space. Inside such blocks every run of end marks with its
closing quotes or brackets is a candidate, and so is every space between words of a script that has no end marks.

The classifier is trained without labels, on boundaries that are reliable: the end of one block joined to the
beginning of the next is a boundary; an end mark before a small letter, a comma or the like is none; nor is one after
a token (or before a word) that is common beside end marks but practically never ends (begins) a block. Those
frequencies are counted over all documents, in hash tables of fixed size. Words after a candidate count only where the
token before it can end a sentence by its own frequency: after an abbreviation they would tell of the abbreviation.
Features are the neighbouring tokens (by the same frequencies), their case, length, digits and script, the marks and
the white space between. Tokens are what white space sets apart; a longer one than `LONGEST` is known by the characters
beside the candidate.

Repeated texts are removed once and the rest written; the texts are read twice, to list the candidates' hashed
neighbours (three numbers each, from which all frequencies follow) and to split.

Broadcast: the count tables (3 * 2^18 pairs of floats, 6 MB) and the weights of the features met in training.

Defined results: null, empty and white-space texts have no sentences; texts of any length are processed whole;
repeated rows count once; two different texts under one id are both split. Spans are half open, in code points,
without white space at either end, and never overlap.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.session import written

BUCKET_BITS = 18
#: Documents the classifier is fitted on (the frequencies are counted over all), and their greatest length.
TRAIN_DOCUMENTS, TRAIN_CHARACTERS = 3000, 20_000
#: Characters of a token that its frequency is counted by.
LONGEST = 80
EPOCHS, RATE, PENALTY = 12, 0.3, 1e-5
#: Log ratio of a type's rate at block edges to the rate of its mark, below which it is reliably no boundary.
NEVER = -2.0

# End marks, closing and opening characters, scripts written without end marks.
MARKS = ".!?…。！？．｡؟۔।॥‽;;"
CLOSERS = "\"'”’»›)]}」』】）》〉"
OPENERS = "\"'“‘«‹([{「『【（《〈„¿¡"
UNMARKED = ("THAI", "LAO", "KHMER", "MYANMAR")
_INVISIBLE = "​‌‍⁠﻿­‎‏"

_MARK_RUN = re.compile(f"[{re.escape(MARKS)}][{re.escape(MARKS)}{_INVISIBLE}]*(?:[   ][!?]+)?")
_BLANK = re.compile(r"\s*\n\s*\n\s*")
_ITEM = re.compile(r"(?:\d{1,3}[.)]|[-–—•*‣▪·])[ \t ]+(?=\S)")
_SPACE = re.compile(r"\s+")
#: Spaces that may stand between a mark and the marks or closing quotes after it.
_THIN = " \u00a0\u202f"
#: Steps of the ratios.
_STEPS = (-2.6, NEVER, -1.3, -0.7, 0.4, 1.0)
_WORD = re.compile(r"\S+")
#: Where a sentence ran into the next without white space, inside what looks like one token.
_GLUED = re.compile(r".*[^\W\d_]{2,}[.!?]+[\"”’»)]*(?=[^\W\d_])[^\W\d_]")


@lru_cache(65536)
def _kind(ch: str) -> str:
    """l(ower), u(pper), d(igit), o(pening), c(losing), or the script of a caseless letter, or p."""
    if ch == "":
        return "end"
    if ch.isdigit():
        return "d"
    if ch.isalpha() or unicodedata.category(ch)[0] == "M":
        if ch.islower():
            return "l"
        if ch.isupper() or ch.istitle():
            return "u"
        return _script(ch)
    if ch in OPENERS:
        return "o"
    if ch in CLOSERS:
        return "c"
    return ch if ch in ",;:-–—/@&%" else "p"


@lru_cache(65536)
def _script(ch: str) -> str:
    name = unicodedata.name(ch, "?").split(" ")[0].split("-")[0]
    return "HAN" if name in ("CJK", "HIRAGANA", "KATAKANA", "IDEOGRAPHIC", "FULLWIDTH", "HALFWIDTH") else name


def _item(text: str, at: int, hi: int) -> bool:
    """Whether a list item begins here; a dash before a small letter is part of a sentence."""
    m = _ITEM.match(text, at, hi)
    return m is not None and not (text[at] in "-–—" and text[m.end() : m.end() + 1].islower())


def blocks(text: str) -> list[tuple[int, int]]:
    """Spans that layout separates for certain."""
    out = []
    edges, at = [], 0
    for m in _BLANK.finditer(text):
        edges.append((at, m.start()))
        at = m.end()
    edges.append((at, len(text)))
    for lo, hi in edges:
        start, line_lo = lo, lo
        width = max(len(line.strip()) for line in text[lo:hi].split("\n"))
        while True:
            nl = text.find("\n", line_lo, hi)
            if nl < 0:
                out.append((start, hi))
                break
            nxt = nl + 1
            while nxt < hi and text[nxt].isspace():
                nxt += 1
            line, word = text[line_lo:nl].rstrip(), _WORD.match(text, nxt, hi)
            item_now, item_next = _item(text, line_lo, hi), _item(text, nxt, hi) and not line.endswith((",", "-"))
            fits = word is not None and len(line) + 1 + len(word.group()) <= width
            first = text[nxt : nxt + 1]
            ended = line[-1:] in MARKS or line[-1:] in CLOSERS
            item_next = item_next and (item_now or ended or fits or line.endswith(":"))
            if item_next or item_now and not first.islower() and fits or fits and not ended and not first.islower() and len(line) < 0.4 * width and not line.endswith((",", ":", "-", "–")):
                out.append((start, nl))
                start = nxt
            line_lo = nxt
    trimmed = []
    for lo, hi in out:
        while lo < hi and text[lo].isspace():
            lo += 1
        while hi > lo and text[hi - 1].isspace():
            hi -= 1
        if lo < hi:
            trimmed.append((lo, hi))
    return trimmed


_UNMARKED_LETTER = re.compile("[\u0e01-\u17fe]")
_SINGLE_QUOTE = re.compile(r"(?:^|[\s(])'\S")


class _Block:
    """A block of a text with its tokens; quotes are found once, so that a long block costs no more per character."""

    def __init__(self, text: str, lo: int, hi: int):
        self.text, self.lo, self.hi = text, lo, hi
        spans = [m.span() for m in _WORD.finditer(text, lo, hi)]
        self.starts, self.stops = [a for a, _ in spans], [b for _, b in spans]
        self._at: dict[str, list[int]] = {}

    def count(self, ch: str, end: int) -> int:
        """How often a character occurs in the block before end."""
        if ch not in self._at:
            self._at[ch] = [m.start() for m in re.finditer(ch, self.text[self.lo : self.hi])]
        return bisect.bisect_left(self._at[ch], end - self.lo)

    def open_before(self, ch: str, j: int) -> bool:
        """Whether a straight quote at j closes one that opened before."""
        if ch == '"':
            return self.count('"', j) % 2 == 1
        if "'" not in self._at:
            m = _SINGLE_QUOTE.search(self.text[self.lo : self.hi])
            self._at["'"] = [m.end()] if m else []
        return bool(self._at["'"]) and self._at["'"][0] <= j - self.lo

    def candidates(self) -> list[tuple[int, int, int]]:
        """(position of the first mark, end with closers, beginning of what follows)."""
        text, lo, hi = self.text, self.lo, self.hi
        out: list[tuple[int, int, int]] = []
        german = text.find("„", lo, hi) >= 0
        marker = _ITEM.match(text, lo, hi)
        for m in _MARK_RUN.finditer(text, lo, hi):
            i, j = m.span()
            if marker and i < marker.end() or (";" in m.group() or "\u037e" in m.group()) and not self._greek(i):
                continue
            while j < hi:
                ch = text[j]
                if ch in _INVISIBLE or ch in CLOSERS and not (ch in "\"'" and not self.open_before(ch, j)) or ch == "“" and german:
                    j += 1
                elif ch in _THIN and text[j + 1 : min(j + 2, hi)] == "»" and self.count("«", j) > self.count("»", j):
                    j += 2
                else:
                    break
            if out and i < out[-1][1]:
                continue
            nxt = j
            while nxt < hi and text[nxt].isspace():
                nxt += 1
            out.append((i, j, nxt))
        if self.unmarked():
            for m in _SPACE.finditer(text, lo, hi):
                a, b = text[m.start() - 1 : m.start()] if m.start() > lo else "", text[m.end() : m.end() + 1] if m.end() < hi else ""
                if a and b and a not in MARKS and (_script(a) in UNMARKED or _script(b) in UNMARKED) and a not in ",:;":
                    out.append((m.start(), m.start(), m.end()))
        return sorted(out)

    def unmarked(self) -> bool:
        """Whether the block holds letters of a script without end marks."""
        m = _UNMARKED_LETTER.search(self.text, self.lo, self.hi)
        return m is not None and any(_script(c) in UNMARKED for c in set(self.text[m.start() : self.hi]) if "\u0e00" < c < "\u17ff")

    def _greek(self, i: int) -> bool:
        while i > self.lo and self.text[i - 1].isspace():
            i -= 1
        return i > self.lo and _script(self.text[i - 1]) == "GREEK"

    def left(self, i: int, j: int) -> tuple[str, str, str, str]:
        """(token before the marks, the one before it, the marks, their closers)."""
        text = self.text
        k = bisect.bisect_left(self.starts, i) - 1
        token = before = ""
        if k >= 0:
            end = min(self.stops[k], i)
            token = text[max(self.starts[k], end - LONGEST) : end]
            if k > 0:
                before = text[max(self.starts[k - 1], self.stops[k - 1] - LONGEST) : self.stops[k - 1]]
        if i == j:
            marks, closers = "space", ""
        else:
            marks = "".join(c for c in text[i:j] if c not in _INVISIBLE)
            closers = marks.lstrip(MARKS + _THIN)
            marks = marks[: len(marks) - len(closers)].replace("\u00a0", " ").replace("\u202f", " ").strip()
        if token and _kind(token[-1]) not in ("l", "u", "d") and len(token) > 3 and token[-1:].isalpha() or token[-1:] > "\u0e00" or token[-2:-1] > "\u0e00":
            token = token[-3:]
        glued = _GLUED.search(token) if len(token) > 4 else None
        if glued:
            token = token[glued.end() - 1 :]
        return token.strip("(\"'“‘«„[").strip(_INVISIBLE), before, marks, closers

    def right(self, nxt: int) -> str:
        return _right(self.text, nxt, self.hi)

    def last(self, found: list[tuple[int, int, int]]) -> tuple[str, str, str, str] | None:
        """What ends the block: its last candidate, or its last token where it holds a script without marks."""
        if found and found[-1][2] >= self.hi:
            return self.left(*found[-1][:2])
        return self.left(self.hi, self.hi) if self.unmarked() else None


_DIGIT = re.compile(r"\d")


@lru_cache(65536)
def _shape(token: str) -> str:
    return _DIGIT.sub("0", token.lower())


def _left(text: str, lo: int, i: int, j: int) -> tuple[str, str, str, str]:
    """(token before the marks, the one before it, the marks, their closers)."""
    head = text[max(lo, i - 80) : i].rstrip()
    words = head.split()
    marks = "".join(c for c in text[i:j] if c not in _INVISIBLE)
    closers = marks.lstrip(MARKS + "   ")
    marks = marks[: len(marks) - len(closers)].replace(" ", " ").replace(" ", " ").strip()
    if i == j:
        marks = "space"
    token = words[-1] if words else ""
    if token and _kind(token[-1]) not in ("l", "u", "d") and len(token) > 3 and token[-1:].isalpha() or any(ord(c) > 0xE00 for c in token[-2:]):
        token = token[-3:]
    glued = _GLUED.search(token)
    if glued:
        token = token[glued.end() - 1 :]
    return token.strip("(\"'“‘«„[").strip(_INVISIBLE), words[-2] if len(words) > 1 else "", marks, closers


def _right(text: str, nxt: int, hi: int) -> str:
    m = _WORD.match(text, nxt, min(hi, nxt + LONGEST))
    token = m.group() if m else ""
    return token[:2] if token[:1] > "\u0e00" or token[1:2] > "\u0e00" else token


def _keys(left: tuple[str, str, str, str], right: str) -> tuple[str, str, str]:
    token, before, marks, closers = left
    t = _shape(token)
    if len(token) == 1 and token.isalpha() and token.isupper():
        t = "X"
    b = _shape(before) if len(before) < 4 else "0" if before[-1].isdecimal() else "w"
    b = b if len(b) < 4 else "w"
    tail = (marks if len(marks) < 3 else marks[:3]) + closers
    r = _shape(right.strip(",;:.!?"))
    return f"a{t}|{tail}", f"b{b}|{t}|{tail}", f"c{marks == 'space'}|{r}"


@lru_cache(131072)
def _bucket(key: str) -> int:
    return zlib.crc32(key.encode("utf-8", "surrogatepass")) & ((1 << BUCKET_BITS) - 1)


#: Marks after which no space is usual, so that a digit right after them shows nothing.
_WIDE = "。！？｡．"
_REFUSED = {",", ";", ":", "-", "–", "—", "/", "&", "@", "%"}


def _refuses(text: str, j: int, nxt: int, hi: int) -> bool:
    """Whether what follows a candidate shows for certain that the sentence goes on."""
    ch = text[nxt : nxt + 1] if nxt < hi else ""
    kind = _kind(ch)
    at = next((x for x in range(j - 1, max(j - 8, -1), -1) if text[x] in MARKS), -1)
    wide = kind == "d" and at >= 0 and text[at] in _WIDE and not (text[at] == "．" and _kind(text[at - 1 : at]) == "d")
    return kind == "l" or ch in _REFUSED and not _item(text, nxt, hi) or kind == "c" or nxt == j and kind in ("d", "p") and not wide and ch not in MARKS or ch in MARKS and ch != ""


#: Kinds of rows of `_neighbours`: a candidate inside a block, the end of a block, the beginning of the next one.
INSIDE, END, BEGIN = 0, 1, 2


def _neighbours(batches):
    """(a, b, c, kind) of every candidate and edge of blocks: the buckets of its types."""
    for batch in batches:
        rows: list[tuple[int, int, int, int]] = []
        for text in batch["gloss"]:
            before = None
            for lo, hi in blocks(text or ""):
                block = _Block(text, lo, hi)
                found = block.candidates()
                for i, j, nxt in found:
                    if nxt < hi:
                        rows.append((*map(_bucket, _keys(block.left(i, j), block.right(nxt))), INSIDE))
                final = block.last(found)
                if final is not None:
                    rows.append((*map(_bucket, _keys(final, "")), END))
                if before is not None and not _item(text, lo, hi):
                    rows.append((*map(_bucket, _keys(before, block.right(lo))), BEGIN))
                before = final
        yield pd.DataFrame(rows, columns=["a", "b", "c", "kind"])


class Splitter:
    """Frequencies at block edges and the weights of the features."""

    def __init__(self, edge: np.ndarray, every: np.ndarray):
        self.edge, self.every = edge.astype(np.float32), every.astype(np.float32)
        self.base = [float(e.sum() + 1) / float(n.sum() + 2) for e, n in zip(edge, every)]
        self.weights: dict[str, float] = {}
        self._memo: dict[tuple, float] = {}
        self.ratios = [np.log((self.edge[t] + 2 * q) / (self.every[t] + 2) / q).astype(np.float32) for t, q in enumerate(self.base)]

    def ratio(self, t: int, key: str) -> float:
        """Smoothed log ratio of a type's rate at block edges to that of all types."""
        return float(self.ratios[t][_bucket(key)])

    def _parts(self, left: tuple[str, str, str, str], right: str, sep: str) -> tuple[tuple, tuple, list[float]]:
        """(what is seen of the candidate, what is known of its tokens, their ratios): few values each, so that what
        follows from them is remembered."""
        token, _, marks, closers = left
        ratios = [self.ratio(t, k) for t, k in enumerate(_keys(left, right))]
        nk, lk = _kind(right[:1]), _kind(token[-1:])
        after = _kind(next((c for c in right if c not in OPENERS), "")) if nk == "o" else nk
        script = _script(token[-1]) if token and token[-1].isalpha() else lk
        m = marks if len(marks) < 4 else marks[:3]
        seen = (m, closers, script, sep, nk, after, lk, min(len(token), 6), "." in token[:-1], min(len(right), 6), len(token) == 1 and token.isupper())
        return seen, (*[bisect.bisect(_STEPS, r) for r in ratios], nk, m), ratios

    @staticmethod
    def _seen(part: tuple) -> list[str]:
        m, closers, script, sep, nk, after, lk, length, dotted, right, one = part
        return [
            "1", f"m{m}", f"c{closers}", f"mc{m}{closers}{script}", f"s{sep}", f"s{sep}{nk}", f"s{sep}{lk}{nk}", f"n{nk}{after}", f"l{lk}", f"ln{lk}{nk}", f"mn{m}{nk}{after}", f"len{length}", f"len{length}{lk}",
            f"dot{dotted}", f"rl{right}", f"sc{script}{m}", f"one{one}", f"q{bool(closers)}{nk}{script}",
        ]

    @staticmethod
    def _known(part: tuple) -> list[str]:
        a, b, c, nk, m = part
        return [f"A{a}", f"B{b}", f"C{c}", f"AC{a}|{c}", f"ABC{min(a, b, c)}", f"A{a}n{nk}", f"C{c}m{m}"]

    def features(self, left: tuple[str, str, str, str], right: str, sep: str) -> tuple[list[str], list[float]]:
        seen, known, ratios = self._parts(left, right, sep)
        return self._seen(seen) + self._known(known), ratios

    def score(self, left: tuple[str, str, str, str], right: str, sep: str) -> float:
        """The sum of the weights of all features."""
        total = 0.0
        for names, part in zip((self._seen, self._known), self._parts(left, right, sep)[:2]):
            value = self._memo.get(part)
            if value is None:
                value = sum(self.weights.get(k, 0.0) for k in names(part))
                if len(self._memo) < 200_000:  # a full memory costs time, not results
                    self._memo[part] = value
            total += value
        return total

    def _sep(self, text: str, j: int, nxt: int) -> str:
        gap = text[j:nxt]
        return "none" if not gap else "line" if "\n" in gap else "space"

    def fit(self, texts: list[str]) -> None:
        """Train on the reliable boundaries of some texts."""
        rows, labels = [], []
        for text in texts:
            last = None
            for lo, hi in blocks(text):
                block = _Block(text, lo, hi)
                found = block.candidates()
                for i, j, nxt in found:
                    if nxt < hi:
                        f, ratios = self.features(block.left(i, j), block.right(nxt), self._sep(text, j, nxt))
                        if _refuses(text, j, nxt, hi) or min(ratios) < NEVER:
                            rows.append(f)
                            labels.append(0.0)
                if last is not None and not _item(text, lo, hi):
                    right = block.right(lo)
                    for sep in ("space", "space", "space", "line", "none"):
                        rows.append(self.features(last, right, sep)[0])
                        labels.append(1.0)
                last = block.last(found)
        if not rows:
            return
        index: dict[str, int] = {}
        flat = np.fromiter((index.setdefault(x, len(index)) for r in rows for x in r), np.int64)
        x = flat.reshape(len(rows), -1)
        y = np.array(labels)
        # rare class weighted up so that both count alike
        weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
        w, g2 = np.zeros(len(index)), np.full(len(index), 1e-8)
        order = np.random.default_rng(0)
        for _ in range(EPOCHS):
            for part in np.array_split(order.permutation(len(rows)), max(1, len(rows) // 2000)):
                p = 1 / (1 + np.exp(-w[x[part]].sum(1)))
                d = (p - y[part]) * weight[part] / len(part)
                grad = np.bincount(x[part].ravel(), np.repeat(d, x.shape[1]), len(index)) + PENALTY * w
                g2 += grad * grad
                w -= RATE * grad / np.sqrt(g2)
        self.weights = {k: float(w[i]) for k, i in index.items()}

    def split(self, text: str | None) -> list[tuple[int, int]]:
        """Spans of the sentences of a text."""
        out: list[tuple[int, int]] = []
        if not text:
            return out
        for lo, hi in blocks(text):
            at, block = lo, _Block(text, lo, hi)
            for i, j, nxt in block.candidates():
                if nxt >= hi or j <= at or _refuses(text, j, nxt, hi):
                    continue
                if self.score(block.left(i, j), block.right(nxt), self._sep(text, j, nxt)) > 0:
                    out.append((at, j))
                    at = nxt
            if at < hi:
                out.append((at, hi))
        return out


def train(texts: DataFrame) -> Splitter:
    """The splitter of a corpus; texts has a column gloss."""
    size = 1 << BUCKET_BITS
    edge, every = np.zeros((3, size)), np.zeros((3, size))
    rows = written(texts.select("gloss").mapInPandas(_neighbours, "a int, b int, c int, kind int"), "neighbours")

    def fill(t: int, counts: DataFrame) -> None:
        own = counts.groupBy("h").agg(F.sum("edge").alias("edge"), F.sum("n").alias("n")).toPandas()  # at most 2^18 rows
        edge[t, own["h"]], every[t, own["h"]] = own["edge"], own["n"]

    for t, column in enumerate("ab"):
        fill(t, rows.filter(F.col("kind") != BEGIN).select(F.col(column).alias("h"), (F.col("kind") == END).cast("long").alias("edge"), F.lit(1).alias("n")))
    before = Splitter(edge, every)
    able = rows.sparkSession.sparkContext.broadcast(before.ratios[:2])

    def after(batches):
        for x in batches:
            kept = x[(able.value[0][x["a"]] >= NEVER) & (able.value[1][x["b"]] >= NEVER)]
            own = kept.assign(edge=(kept["kind"] == BEGIN).astype(np.int64), n=1).groupby("c", as_index=False)[["edge", "n"]].sum()
            yield own.rename(columns={"c": "h"})

    fill(2, rows.filter(F.col("kind") != END).mapInPandas(after, "h int, edge long, n long"))
    splitter = Splitter(edge, every)
    short = texts.select("gloss").filter((F.col("gloss") != "") & (F.char_length("gloss") <= TRAIN_CHARACTERS))
    splitter.fit(list(short.orderBy(F.xxhash64("gloss"), "gloss").limit(TRAIN_DOCUMENTS).toPandas()["gloss"]))
    return splitter


def sentences(documents: DataFrame) -> DataFrame:
    """(doc_id, span_lo, span_hi) of every sentence of document.gloss."""
    texts = written(documents.select(F.col("id").alias("doc_id"), "gloss").filter(F.col("gloss") != "").distinct(), "texts")
    shared = documents.sparkSession.sparkContext.broadcast(train(texts))

    def run(batches):
        splitter = shared.value
        for b in batches:
            rows = [(k, lo, hi) for k, t in zip(b["doc_id"], b["gloss"]) for lo, hi in splitter.split(t)]
            yield pd.DataFrame(rows, columns=["doc_id", "span_lo", "span_hi"])

    return texts.mapInPandas(run, "doc_id string, span_lo int, span_hi int")
