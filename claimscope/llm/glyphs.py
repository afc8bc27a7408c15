"""One form for text that reads alike: widths, composition, invisible characters, spaces and look-alike letters.

`fold` is what any single text allows: full- and half-width forms and presentation forms become the plain
character, canonical composition (NFC), invisible format characters go, every space becomes U+0020. What a reader
can see stays: case, accents, raised digits, ligatures of other kinds, added marks.

Look-alikes need more than the character: only a token that mixes scripts, or one whose letters all have a twin in
the script that dominates its text, is a candidate; its dominant script is tried first, and the substitution holds
only if the result occurs in the corpus vocabulary. Candidates are few and distinct, so they are what is shuffled:
the vocabulary is reduced by a semi-join on them, and the repairs return to the texts by their own key.

Defined results: null stays null, empty stays empty; text of any length is processed whole; equal texts get equal
forms; a mixed token without a known reading is left as folded.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimscope.session import written

# Letters of one shape, Latin first in each pair.
LATIN_CYRILLIC = "AА BВ CС EЕ HН IІ JЈ KК MМ OО PР SЅ TТ XХ YУ aа cс dԁ eе hһ iі jј lӏ oо pр qԛ sѕ vѵ wԝ xх yу"
LATIN_GREEK = "AΑ BΒ EΕ HΗ IΙ KΚ MΜ NΝ OΟ PΡ TΤ XΧ YΥ ZΖ oο vν"

#: Decompositions that only change width or joining shape.
_SHAPES = ("<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>", "<noBreak>")
#: Format characters a reader does see.
_VISIBLE_FORMAT = {0x0600, 0x0601, 0x0602, 0x0603, 0x0604, 0x0605, 0x06DD, 0x070F, 0x08E2}
_HYPHENS = {0x2010: "-", 0x2011: "-"}

_PAIRS: dict[str, dict[str, str]] = {}
for _pairs, _script_name in ((LATIN_CYRILLIC, "CYRILLIC"), (LATIN_GREEK, "GREEK")):
    for _latin, _other in _pairs.split():
        _PAIRS.setdefault(_other, {})["LATIN"] = _latin
        _PAIRS.setdefault(_latin, {})[_script_name] = _other
for _c in list(_PAIRS):  # Cyrillic and Greek twins share their Latin twin
    _l = _PAIRS[_c].get("LATIN")
    if _l:
        for _s, _o in _PAIRS[_l].items():
            if _o != _c:
                _PAIRS[_c].setdefault(_s, _o)

_TOKEN = re.compile(r"[^\W_]+(?:[^\W_]|[̀-ͯ])*")


@lru_cache(65536)
def _folded(ch: str) -> str:
    code = ord(ch)
    if code in _HYPHENS:
        return _HYPHENS[code]
    category = unicodedata.category(ch)
    if category == "Cf" and code not in _VISIBLE_FORMAT or code == 0x34F or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF:
        return ""
    if category in ("Zs", "Zl", "Zp") or ch in "\t\n\r\x0b\x0c\x85":
        return " "
    shape = unicodedata.decomposition(ch)
    if shape.startswith(_SHAPES) or 0x2E80 <= code <= 0x2FDF and shape:  # radicals stored for the characters they are
        return "".join(_folded(chr(int(x, 16))) for x in shape.split()[1:])
    return ch


class _Folds(dict):
    """Code point -> its folded form, made as characters are met."""

    def __init__(self, keep: str = ""):
        super().__init__({ord(c): c for c in keep})

    def __missing__(self, code: int) -> str:
        self[code] = form = _folded(chr(code))
        return form


_ALL, _IN_LINES = _Folds(), _Folds("\n")


def fold(text: str, breaks: bool = True) -> str:
    """The form of a text that needs no context. breaks: line breaks become spaces."""
    if text.isascii():
        return text if not breaks else re.sub(r"[\t\n\r\x0b\x0c]", " ", text)
    return unicodedata.normalize("NFC", text.translate(_ALL if breaks else _IN_LINES))


@lru_cache(65536)
def _script(ch: str) -> str:
    """LATIN, CYRILLIC or GREEK of a letter, else empty."""
    if not ch.isalpha():
        return ""
    if ch.isascii():
        return "LATIN"
    name = unicodedata.name(ch, "").split(" ", 1)[0]
    return name if name in ("LATIN", "CYRILLIC", "GREEK") else ""


def _main(letters: str) -> str:
    """The script of most letters that have no twin elsewhere; empty if every letter has one."""
    sure = Counter(s for c in letters for s in [_script(c)] if s and c not in _PAIRS)
    return max(sure, key=lambda s: (sure[s], s)) if sure else ""


def doubtful(folded: str) -> list[str]:
    """Tokens that may hold look-alikes, as "main script of the text<tab>token": tokens of mixed script, tokens of
    twins only in a text of another script, and all tokens of a text that has nothing but twins."""
    if folded.isascii() and not all(c in _PAIRS or not c.isalpha() for c in folded):
        return []
    scripts = {s for s in map(_script, folded) if s}
    main = _main(folded)
    if not scripts or len(scripts) < 2 and main:
        return []
    out = set()
    for token in set(_TOKEN.findall(folded)):
        own = {s for s in map(_script, token) if s}
        if len(own) > 1 or own and main not in own and all(c in _PAIRS or not _script(c) for c in token):
            out.add(f"{main}\t{token}")
    return sorted(out)


def readings(doubt: str) -> list[str]:
    """Readings of a doubtful token in one script each, as "rank<tab>reading": the script of its own letters without
    a twin or, where it has none, the text's main script ranks before the others."""
    main, token = doubt.split("\t")
    own = _main(token) or main
    out = []
    for target in ("LATIN", "CYRILLIC", "GREEK"):
        if all(s in ("", target) or target in _PAIRS.get(c, {}) for c in token for s in [_script(c)]):
            reading = unicodedata.normalize("NFC", "".join(c if _script(c) in ("", target) else _PAIRS[c][target] for c in token))
            out.append(f"{int(target != own)}\t{reading}")
    return out


@F.pandas_udf(T.StructType([T.StructField("folded", T.StringType()), T.StructField("doubtful", T.ArrayType(T.StringType()))]))
def _fold_udf(texts: pd.Series) -> pd.DataFrame:
    folded = [None if t is None else fold(t) for t in texts]
    return pd.DataFrame({"folded": folded, "doubtful": [[] if t is None else doubtful(t) for t in folded]})


@F.pandas_udf(T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType()), T.StructField("doubtful", T.ArrayType(T.StringType()))]))
def _pair_udf(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Both folded, and the doubtful tokens of both where they still differ."""
    rows = [(fold(x), fold(y)) for x, y in zip(a, b)]
    return pd.DataFrame({"a": [x for x, _ in rows], "b": [y for _, y in rows], "doubtful": [[] if x == y else sorted({*doubtful(x), *doubtful(y)}) for x, y in rows]})


@F.pandas_udf(T.ArrayType(T.StringType()))
def _readings_udf(tokens: pd.Series) -> pd.Series:
    return tokens.map(readings)


def _repaired(text: str, doubts: list[str], forms: list[str]) -> str:
    """A folded text with its doubtful tokens in their reading; a doubt counts under the text's own main script."""
    main = _main(text)
    table = {d.split("\t")[1]: f for d, f in zip(doubts, forms) if d.split("\t")[0] == main}
    return _TOKEN.sub(lambda m: table.get(m.group(), m.group()), text)


@F.pandas_udf(T.StringType())
def _repair_udf(folded: pd.Series, doubts: pd.Series, forms: pd.Series) -> pd.Series:
    return pd.Series([t if t is None or d is None or len(d) == 0 else _repaired(t, d, f) for t, d, f in zip(folded, doubts, forms)], dtype=object)


def vocabulary(texts: list[DataFrame]) -> DataFrame:
    """(token, n): the tokens of one script of all texts of the corpus with their counts; each input has one string
    column. Counted within each batch before the shuffle."""

    def tokens(batches):
        for b in batches:
            found: Counter = Counter()
            for t in b.iloc[:, 0]:
                if t is not None:
                    found.update(_TOKEN.findall(fold(t)))
            kept = [(x, n) for x, n in found.items() if len({s for s in map(_script, x) if s}) == 1]
            yield pd.DataFrame(kept, columns=["token", "n"])

    parts = [df.select(F.col(df.columns[0]).cast("string")).mapInPandas(tokens, "token string, n long") for df in texts]
    return reduce(DataFrame.unionByName, parts).groupBy("token").agg(F.sum("n").alias("n"))


def repairs(doubts: DataFrame, vocab: DataFrame) -> DataFrame:
    """(doubt, reading) for each doubtful token with another reading in the vocabulary: the best rank, then the most
    frequent, then the least reading."""
    each = doubts.select("doubt").distinct().select("doubt", F.explode(_readings_udf("doubt")).alias("r"))
    each = each.select("doubt", F.substring_index("r", "\t", 1).cast("int").alias("rank"), F.substring_index("r", "\t", -1).alias("reading"))
    known = written(each, "readings").join(vocab.withColumnRenamed("token", "reading"), "reading")
    best = known.groupBy("doubt").agg(F.min_by("reading", F.struct("rank", -F.col("n"), "reading")).alias("reading"))
    return best.filter(F.substring_index("doubt", "\t", -1) != F.col("reading"))


def _with_repairs(rows: DataFrame, key: list[str], doubtful_tokens: str, vocab: DataFrame) -> DataFrame:
    """rows with _r: the repairs of the doubtful tokens of each row, null where it has none. A row has no more
    repairs than tokens."""
    doubt = rows.filter(F.size(doubtful_tokens) > 0).select(*key, F.explode(doubtful_tokens).alias("doubt"))
    own = doubt.join(repairs(doubt, vocab), "doubt").groupBy(*key).agg(F.sort_array(F.collect_set(F.struct("doubt", "reading"))).alias("_r"))
    return rows.join(own, key, "left")


def one_form(texts: DataFrame, text: str, vocab: DataFrame) -> DataFrame:
    """texts with `form` added. Each text is folded once; repairs come back by a 128-bit hash of the folded text."""
    folded = written(texts.withColumn("_f", _fold_udf(text)).select(*texts.columns, F.col("_f.folded").alias("_folded"), F.col("_f.doubtful").alias("_doubts"), F.md5("_f.folded").alias("_key")), "folded")
    whole = _with_repairs(folded.filter(F.size("_doubts") > 0).select("_key", "_doubts").dropDuplicates(["_key"]), ["_key"], "_doubts", vocab).select("_key", "_r")
    return folded.join(whole, "_key", "left").withColumn("form", _repair_udf(F.col("_folded"), F.col("_r.doubt"), F.col("_r.reading"))).select(*texts.columns, "form")


def slices(responses: DataFrame, documents: DataFrame) -> DataFrame:
    """Each answer's gloss beside the document's text under its span (in code points); repeated answers repeat. Answers
    with a null or a span outside of the text have no slice and are left out."""
    r = responses.select("assignment_id", "doc_id", F.col("span.lo").alias("span_lo"), F.col("span.hi").alias("span_hi"), "gloss").dropna()
    d = documents.select(F.col("id").alias("doc_id"), F.col("gloss").alias("doc_gloss")).dropna().distinct()
    inside = (F.col("span_lo") >= 0) & (F.col("span_hi") > F.col("span_lo")) & (F.col("span_hi") <= F.char_length("doc_gloss"))
    return r.join(d, "doc_id").filter(inside).withColumn("under", F.substring("doc_gloss", F.col("span_lo") + 1, F.col("span_hi") - F.col("span_lo"))).drop("doc_gloss")


def same_reading(pairs: DataFrame, a: str, b: str, vocab: DataFrame) -> DataFrame:
    """Distinct rows of pairs whose two texts differ and have one form. Both are folded beside each other and written
    once; only pairs that still differ and hold doubtful tokens meet the vocabulary."""
    differing = pairs.filter(F.col(a) != F.col(b)).distinct().withColumn("_f", _pair_udf(a, b))
    folded = written(differing.select(*pairs.columns, "_f.*", F.md5(F.to_json(F.struct(*pairs.columns))).alias("_key")), "differing")
    equal = folded.filter("a = b")
    open_pairs = _with_repairs(folded.filter("a <> b AND size(doubtful) > 0"), ["_key"], "doubtful", vocab).filter("_r IS NOT NULL")
    repaired = open_pairs.filter(_repair_udf(F.col("a"), F.col("_r.doubt"), F.col("_r.reading")) == _repair_udf(F.col("b"), F.col("_r.doubt"), F.col("_r.reading")))
    return equal.select(*pairs.columns).unionByName(repaired.select(*pairs.columns))
