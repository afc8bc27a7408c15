"""Text decoded with the wrong encoding: found by a character n-gram model, restored by the likeliest chain.

A smoothed character trigram model is counted over all presumed-clean records (one distributed pass; each task
counts whole batches into hash buckets, so the model has a fixed size whatever the corpus). A second pass scores
every text, a batch at a time; pieces that hold an unlikely non-ASCII character try every chain "encode as A, decode
as B", and after a decoding from UTF-8 every chain again, and keep the likeliest reading. A third pass, over the texts
with such pieces only, accepts readings that gain more than a margin in log-likelihood, also for parts of a piece, and
goes on with the result as long as it gains, for text that was garbled several times.

The margin is validated on held-out text: the gains of all such pieces of all presumed-clean records, where each record's
own text is scored by the model without its own counts; the margin lies above all but one in two hundred of these
gains, and no lower than `LEAST_MARGIN`.

A text is garbled if a piece gains more than the margin, or holds U+FFFD (bytes were lost; such text is found but
can't be restored). `restored` is the whole text with every such piece repaired, null where bytes were lost. Within a
text the chain that repaired most pieces also serves pieces for which it is merely likelier; that changes what is
restored, not what is found.

Broadcast: three count tables of fixed size (2^16 + 2^20 + 2^21 floats, 12 MB), never growing with the data.

Defined results: null and empty texts are never garbled; any length is processed whole; repeated rows give one
result per doc_id and text; other columns don't matter.
"""

from __future__ import annotations

import codecs
import importlib
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.session import written

BITS = (16, 20, 21)
#: Weight of the shorter context, as a share of all characters: rare contexts (garbled rows that slipped into the
#: training) fall back to the rarity of their characters. Behaves alike at every corpus size.
BACKOFF = 2e-6
#: A non-ASCII character less likely than this (log) makes its piece worth trying.
DOUBT = -7.0
LEAST_MARGIN = 4.0
#: Unlikely characters that make the part of a piece they span worth trying by itself: fewer are too little to tell a
#: rare name from garbled text (the margin is validated on whole pieces).
LEAST_UNLIKELY = 4
#: Share of the held-out gains below the margin.
VALIDATED = 0.995

# Encodings a text may wrongly have been read as, and encodings its bytes may really be in.
READ_AS = ("cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "cp866", "koi8-r", "mac-roman", "cp1253", "cp1254", "cp1256", "cp874", "iso8859-2", "iso8859-5", "iso8859-7", "gbk", "gb18030", "cp932", "big5", "euc-jp", "euc-kr")
TRUE = ("utf-8", "cp1251", "koi8-r", "cp866", "iso8859-5", "cp1253", "iso8859-7", "cp1256", "iso8859-6", "cp874", "gb18030", "big5", "euc-jp", "cp932", "cp1252", "cp1250", "iso8859-2", "cp437", "cp850", "mac-roman", "euc-kr")
_MULTI = {"gbk", "gb18030", "cp932", "big5", "euc-jp", "euc-kr"}

_PIECE = re.compile(r"[^ \t\n\r。！？]+[。！？]?")
_FOREIGN = re.compile(r"[^\x00-\x7f]")
_RUN = re.compile(r"[^\x00-\x7f]+")
_PLAIN_RUN = re.compile(r"[\x80-׿ -⯿｡-ﾟ]+")
_BAD = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f�-]")
#: Signs of a record that is not clean enough to train on.
_UNCLEAN = re.compile(r"[\x80-\x9f�─-▟-]|[\xa1-\xff]{4}|[а-яё][А-ЯЁ]|[｡-ﾟ][一-鿿]|[一-鿿][｡-ﾟ]|[ÃÂÐÑÎÏØÙàâ][\x80-\xbf€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]")


@lru_cache(None)
def _table(codec: str) -> dict[int, int]:
    """Character -> byte of a single-byte codec; bytes it leaves undefined stand for themselves."""
    out = {}
    for b in range(256):
        try:
            out[ord(bytes([b]).decode(codec))] = b
        except UnicodeDecodeError:
            out.setdefault(b, b)
    return out


def _encode(text: str, codec: str) -> bytes | None:
    try:
        return text.encode(codec) if codec in _MULTI else codecs.charmap_encode(text, "strict", _table(codec))[0]
    except UnicodeEncodeError:
        return None


@lru_cache(None)
def _decoders() -> list[tuple[str, str | None]]:
    """The encodings of TRUE with their tables of 256 characters, None for those that have none."""
    out = []
    for codec in TRUE:
        module = importlib.import_module("encodings." + codecs.lookup(codec).name.replace("-", "_"))
        out.append((codec, getattr(module, "decoding_table", None)))
    return out


def _decoded(raw: bytes, codec: str) -> str | None:
    try:
        return raw.decode(codec)
    except UnicodeDecodeError:
        return None


def _bad(text: str) -> bool:
    return "\ufffd" in text if text.isprintable() else _BAD.search(text) is not None


def _steps(piece: str) -> list[tuple[str, str, str]]:
    """(result, encoding, decoding) of every chain of one step that can be applied, equal bytes once."""
    seen: set[bytes] = set()
    out = []
    for a in READ_AS:
        raw = _encode(piece, a)
        if raw is None or raw in seen:
            continue
        seen.add(raw)
        for b, table in _decoders():
            try:
                text = raw.decode(b) if table is None else codecs.charmap_decode(raw, "strict", table)[0]
            except UnicodeDecodeError:
                continue
            if text != piece and b != a:
                out.append((text, a, b))
    return out


@lru_cache(4_000)
def readings(piece: str) -> dict[str, str]:
    """What each chain makes of a piece: result -> name of its chain. Text that decodes from UTF-8 goes through every
    chain once more."""
    out: dict[str, str] = {}
    for text, a, b in _steps(piece):
        if b == "utf-8" and not text.isascii():
            for second, a2, b2 in _steps(text):
                if second != piece and not _bad(second):
                    out.setdefault(second, f"{a}>utf-8,{a2}>{b2}")
        if not _bad(text):  # one step names a result before two do
            out[text] = f"{a}>{b}" if "," in out.get(text, ",") else out[text]
    return out


def through(piece: str, chain: str) -> str | None:
    """What a named chain makes of a piece, null where it can't be applied."""
    for step in chain.split(","):
        a, b = step.split(">")
        raw = _encode(piece, a)
        piece = _decoded(raw, b) if raw is not None else None
        if piece is None:
            return None
    return piece


def _codes(text: str) -> np.ndarray:
    """Code points with all digits alike."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    return np.where((c >= 48) & (c <= 57), np.uint64(48), c)


_FIRST = np.zeros(1, dtype=np.int64)
_MUL = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.uint64(32)


def _buckets(c: np.ndarray, starts: np.ndarray = _FIRST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of each character, of it and the one before, of it and the two before; texts begin after two spaces.
    starts: where texts begin in c."""
    if not len(c):
        return c.astype(np.int64), c.astype(np.int64), c.astype(np.int64)
    b = np.concatenate(([_SPACE], c[:-1]))
    b[starts] = _SPACE
    a = np.concatenate(([_SPACE], b[:-1]))
    a[starts] = _SPACE
    two = c + (b << np.uint64(21))
    return tuple(((x * _MUL) >> np.uint64(64 - bits)).astype(np.int64) for x, bits in zip((c, two, two + (a << np.uint64(42))), BITS))


#: Characters scored at a time: enough for array operations to pay, few enough for their temporaries.
CHUNK = 1 << 17


def _chunks(texts: list[str]):
    """(first, end) of runs of texts of about CHUNK characters; a longer text is a run of its own."""
    first = size = 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > CHUNK:
            yield first, i
            first, size = i, 0
        size += len(t)
    if texts:
        yield first, len(texts)


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes of all texts, where each begins); no text may be empty."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    return _codes("".join(texts)), np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)


@lru_cache(1)
def _scratch() -> np.ndarray:
    """A table of zeros that is left as it was found."""
    return np.zeros(1 << max(BITS), dtype=np.int32)


def _own(h: np.ndarray) -> np.ndarray:
    """How often each bucket occurs in h itself."""
    table = _scratch()
    np.add.at(table, h, 1)
    n = table[h]
    table[h] = 0
    return n


def presumed_clean(text: str) -> bool:
    """Whether a record may train the model."""
    if text.isascii():
        return True
    if _UNCLEAN.search(text):
        return False
    return not any(_reads_as_utf8(run) for run in set(_RUN.findall(text)) if len(run) > 1)


@lru_cache(1)
def _leads() -> dict[int, list[str]]:
    """Character -> the single-byte encodings in which it is a byte that may begin a UTF-8 character."""
    out: dict[int, list[str]] = {}
    for codec in READ_AS:
        if codec not in _MULTI:
            for ch, byte in _table(codec).items():
                if 0xC2 <= byte <= 0xF4:
                    out.setdefault(ch, []).append(codec)
    return out


@lru_cache(20_000)
def _reads_as_utf8(run: str) -> bool:
    """Whether the bytes of a run of non-ASCII characters in some single-byte encoding are UTF-8."""
    for codec in _leads().get(ord(run[0]), ()):
        if codec not in _MULTI:
            raw = _encode(run, codec)
            if raw and _decoded(raw, "utf-8"):
                return True
    return False


class Model:
    """Interpolated trigram model over hashed counts."""

    def __init__(self, n1: np.ndarray, n2: np.ndarray, n3: np.ndarray, margin: float = LEAST_MARGIN):
        self.n1, self.n2, self.n3, self.margin = n1, n2, n3, margin
        self.total = float(n1.sum()) or 1.0
        self.space = float(self.n1[int((32 * int(_MUL) % (1 << 64)) >> (64 - BITS[0]))])
        self.cache: dict[tuple[str, str, str], tuple[float, str, str]] = {}

    def load(self) -> list[float]:
        """The filled share of each table."""
        return [float((n > 0).mean()) for n in (self.n1, self.n2, self.n3)]

    def logs(self, c: np.ndarray, starts: np.ndarray = _FIRST, held_out: bool = False) -> np.ndarray:
        """log p of each character after the two before it. held_out: by the counts of all texts but this one."""
        if not len(c):
            return np.zeros(0)
        h1, h2, h3 = _buckets(c, starts)
        n1, n2, n3, total = self.n1[h1], self.n2[h2], self.n3[h3], self.total
        if held_out:
            n1, n2, n3, total = n1 - _own(h1), n2 - _own(h2), n3 - _own(h3), total - len(c)
        k = BACKOFF * total + 1.0
        p1 = (n1 + 0.1) / (total + 0.1 * (1 << BITS[0]))
        before1 = np.concatenate(([self.space], n1[:-1]))
        before1[starts] = self.space
        p2 = (n2 + k * p1) / (before1 + k)
        before2 = np.concatenate(([0.0], n2[:-1]))
        before2[starts] = 0.0
        return np.log(np.minimum((n3 + k * p2) / (before2 + k), 1.0))

    def score(self, text: str) -> float:
        return float(self.logs(_codes(text)).sum())

    def best(self, left: str, piece: str, right: str) -> tuple[float, str, str]:
        """(score, reading, chain) of the best reading of a piece between the two characters on each side, with the
        characters on the right counted; all readings are scored in one pass."""
        key = (left[-2:], piece, right[:2])
        found = self.cache.get(key)
        if found is None:
            options = list(readings(piece))
            if options:
                left, right = left[-2:].rjust(2), right[:2]
                parts = [left + t + right for t in options]
                logs = self.logs(_codes("".join(parts)))
                ends = np.cumsum([len(p) for p in parts])
                sums = np.concatenate(([0.0], np.cumsum(logs)))
                # the two characters of context before a piece don't count: their own context is the text before
                scores = sums[ends] - sums[np.concatenate(([0], ends[:-1])) + 2]
                at = int(np.argmax(scores))
                found = (float(scores[at]), options[at], readings(piece)[options[at]])
            else:
                found = (-np.inf, piece, "")
            if len(self.cache) < 200_000:  # a cache only: a full one costs time, not results
                self.cache[key] = found
        return found

    def repair(self, left: str, piece: str, right: str, logs: np.ndarray, first: tuple[float, str, str]) -> tuple[str, list[str]] | None:
        """Best repair of a doubtful piece in its surroundings: whole, by its runs, or its unlikely middle; again as
        long as a round gains, for text that was garbled more than once. logs: those of piece and right; first: its
        best reading as a whole."""
        chains: list[str] = []
        text = piece
        while True:
            step = self._once(left, text, right, logs, first)
            # only UTF-8 shows for certain that text was garbled again, and decoding from it shortens the text
            if step is None or chains and ("utf-8" not in step[1] or len(step[0]) >= len(text)):
                break
            text, chain = step
            chains.append(chain)
            if text.isascii():
                break
            logs, first = self.logs(_codes(left[-2:].rjust(2) + text + right[:2]))[2:], self.best(left, text, right)
        return (text, chains) if chains else None

    def _once(self, left: str, piece: str, right: str, logs: np.ndarray, first: tuple[float, str, str]) -> tuple[str, str] | None:
        if first[0] - logs.sum() > self.margin:
            return first[1:]
        whole = left[-2:] + piece + right[:2]
        shift = len(left[-2:])

        def part(i: int, j: int) -> tuple[float, str, str]:
            score, text, chain = self.best(whole[max(0, i + shift - 2) : i + shift], piece[i:j], whole[j + shift : j + shift + 2])
            return score - logs[i : j + 2].sum(), text, chain

        out, at, chains = [], 0, []
        for m in _PLAIN_RUN.finditer(piece):
            if (m.start(), m.end()) == (0, len(piece)):
                break
            gain, text, chain = part(m.start(), m.end())
            if gain > self.margin:
                out += [piece[at : m.start()], text]
                at = m.end()
                chains.append(chain)
        if chains:
            return "".join([*out, piece[at:]]), chains[0]
        low = np.flatnonzero(logs[: len(piece)] < DOUBT)
        if len(low) >= LEAST_UNLIKELY:
            lo, hi = int(low[0]), min(int(low[-1]) + 1, len(piece))
            for i, j in ((lo, hi), (max(0, lo - 1), hi), (lo, min(len(piece), hi + 1)), (max(0, lo - 1), min(len(piece), hi + 1))):
                if (i, j) != (0, len(piece)):
                    gain, text, chain = part(i, j)
                    if gain > self.margin:
                        return piece[:i] + text + piece[j:], chain
        return None

    def _doubtful(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(logs, doubt, starts) of texts end to end; none may be empty."""
        codes, starts = _joined(texts)
        logs = self.logs(codes, starts)
        foreign = codes > 127
        near = foreign | np.concatenate(([False], foreign[:-1]))
        near[starts] = foreign[starts]
        return logs, (logs < DOUBT) & near, starts

    def doubts(self, texts: list[str]) -> list[tuple[int, list[float], list[tuple[int, float, str, str]]]]:
        """For each text (not empty, not ASCII) with doubtful pieces or lost bytes: its number; what the best readings of
        its pieces gain by the counts of all other texts, if it is presumed clean; and of each doubtful piece where it
        begins, and score, reading and chain of its best reading."""
        return [(lo + i, gains, pieces) for lo, hi in _chunks(texts) for i, gains, pieces in self._doubts(texts[lo:hi])]

    def _doubts(self, texts: list[str]) -> list[tuple[int, list[float], list[tuple[int, float, str, str]]]]:
        logs, doubt, starts = self._doubtful(texts)
        out = []
        for i in np.flatnonzero(np.logical_or.reduceat(doubt, starts) | np.fromiter(("\ufffd" in t for t in texts), bool, len(texts))).tolist():
            text, at = texts[i], int(starts[i])
            before = np.concatenate(([0], np.cumsum(doubt[at : at + len(text)]))).tolist()
            pieces = []
            for m in _PIECE.finditer(text):
                lo, hi = m.span()
                if before[hi] > before[lo] and not m.group().isascii():
                    pieces.append((lo, *self.best(text[max(0, lo - 2) : lo], m.group(), text[hi : hi + 2]), hi))
            gains = []
            if pieces and presumed_clean(text):
                own = np.concatenate(([0.0], np.cumsum(self.logs(_codes(text), held_out=True))))
                gains = [float(p[1] - own[min(p[4] + 2, len(text))] + own[p[0]]) for p in pieces]
            out.append((i, gains, [p[:4] for p in pieces]))
        return out

    def examined(self, texts: list[str], pieces: list[list[tuple[int, float, str, str]]]) -> list[tuple[str | None, list[str]] | None]:
        """Per text None if it isn't garbled, else (restored text or None, chains); arguments as `doubts` gives them."""
        out = []
        for lo, hi in _chunks(texts):
            logs, _, starts = self._doubtful(texts[lo:hi])
            out += [self._examined(t, logs[a : a + len(t)], p) for t, a, p in zip(texts[lo:hi], starts.tolist(), pieces[lo:hi])]
        return out

    def _examined(self, text: str, logs: np.ndarray, pieces: list[tuple[int, float, str, str]]) -> tuple[str | None, list[str]] | None:
        found: list[tuple[int, int, str, list[str]]] = []
        for lo, *first in pieces:
            m = _PIECE.match(text, lo)
            repaired = self.repair(text[max(0, lo - 2) : lo], m.group(), text[m.end() : m.end() + 2], logs[lo : m.end() + 2], tuple(first))
            if repaired:
                found.append((lo, m.end(), *repaired))
        chains = sorted({c for *_, own in found for c in own})
        if "\ufffd" in text:
            return None, chains
        if not found:
            return None
        done = {f[0] for f in found}
        others = [m.span() for m in _PIECE.finditer(text) if m.start() not in done and not m.group().isascii()]
        found = self._agreed(text, found, others)
        out, at = [], 0
        for lo, hi, new, _ in found:
            out += [text[at:lo], new]
            at = hi
        return "".join([*out, text[at:]]), sorted({c for *_, own in found for c in own})

    def _agreed(self, text: str, found: list, others: list) -> list:
        """Repairs in the light of the whole text: the chain that repaired most of it also serves the pieces for which
        another one, or none, did better by itself, as long as it makes them likelier."""
        names = Counter(chains[0] for *_, chains in found)
        main, n = names.most_common(1)[0]
        if n < 2:
            return found
        out = [f for f in found if f[3][0] == main]
        rest = [(f[0], f[1], f) for f in found if f[3][0] != main] + [(lo, hi, None) for lo, hi in others]
        for lo, hi, old in rest:
            new = through(text[lo:hi], main)
            left, right = text[max(0, lo - 2) : lo].rjust(2), text[hi : hi + 2]
            better = new and new != text[lo:hi] and not _BAD.search(new) and self.score(left + new + right) - self.score(left + text[lo:hi] + right)
            if better and better > (0 if old else self.margin / 2):
                out.append((lo, hi, new, [main]))
            elif old:
                out.append(old)
        return sorted(out)


def _count(batches):
    size = [1 << b for b in BITS]
    for b in batches:
        clean = [t for t in b["text"] if t and presumed_clean(t)]
        sums = [np.zeros(n, dtype=np.int64) for n in size]
        for lo, hi in _chunks(clean):
            for n, h in zip(sums, _buckets(*_joined(clean[lo:hi]))):
                np.add.at(n, h, 1)
        for order, n in enumerate(sums):
            at = np.flatnonzero(n)
            yield pd.DataFrame({"order": order, "bucket": at, "n": n[at]})


def train(texts: DataFrame) -> Model:
    """The model of all presumed-clean records of `texts` (column text)."""
    # the sums have at most 2^16 + 2^20 + 2^21 rows, whatever the corpus
    counts = texts.select("text").mapInPandas(_count, "order int, bucket long, n long").groupBy("order", "bucket").agg(F.sum("n").alias("n")).toPandas()
    tables = []
    for order, bits in enumerate(BITS):
        own = counts[counts["order"] == order]
        table = np.zeros(1 << bits, dtype=np.float32)
        table[own["bucket"].to_numpy()] = own["n"].to_numpy()
        tables.append(table)
    return Model(*tables)


_PIECES = "array<struct<at:int,score:double,text:string,chain:string>>"


def examine(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, restored, chains) of every garbled text."""
    texts = documents.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.col("text").isNotNull() & F.col("text").rlike(r"[^\x00-\x7f]"))
    spark, kind = texts.sparkSession, dict(documents.dtypes)[key]
    shared = spark.sparkContext.broadcast(train(documents.select(F.col(text).alias("text"))))

    def doubts(batches):
        for b in batches:
            keys, own = b["key"].tolist(), b["text"].tolist()
            yield pd.DataFrame([(keys[i], own[i], gains, pieces) for i, gains, pieces in shared.value.doubts(own)], columns=["key", "text", "gains", "pieces"])

    doubtful = written(texts.mapInPandas(doubts, f"key {kind}, text string, gains array<double>, pieces {_PIECES}"), "doubtful")
    bound = doubtful.select(F.explode("gains").alias("gain")).agg(F.percentile_approx("gain", F.lit(VALIDATED), F.lit(10_000)).alias("g")).first()["g"]
    margin = max(LEAST_MARGIN, 1.0 + bound) if bound is not None else LEAST_MARGIN

    def run(batches):
        m = shared.value
        m.margin = margin
        for b in batches:
            pieces = [[(p["at"], p["score"], p["text"], p["chain"]) for p in own] for own in b["pieces"]]
            found = m.examined(b["text"].tolist(), pieces)
            yield pd.DataFrame([(k, *x) for k, x in zip(b["key"], found) if x], columns=["key", "restored", "chains"])

    return doubtful.select("key", "text", "pieces").mapInPandas(run, f"key {kind}, restored string, chains array<string>").withColumnRenamed("key", key)
