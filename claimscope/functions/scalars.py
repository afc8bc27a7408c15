"""Scalar functions of the domain, all as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that names of pages don't keep, each written as '_'.
_WIKI = " []'\"%+?=<>|/()"
_ENTITY = _WIKI + "\\"
#: Bracket and quote tokens of tokenised text.
_WORD = r"[\p{L}\p{M}\p{N}]"
#: Letters, marks and digits of the scripts that set no spaces between words, with the signs of length and voice they share.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\u30FC\u3099\u309A\uFF70\uFF9E\uFF9F&&" + _WORD + "]"
_SPACED = rf"[\p{{L}}\p{{M}}\p{{N}}&&[^{UNSPACED}]]"

TOKENS = {"-LRB-": "(", "-RRB-": ")", "-LSB-": "[", "-RSB-": "]", "-LCB-": "{", "-RCB-": "}", "``": '"', "''": '"', "`": "'"}


def wikify(text: Column) -> Column:
    return F.translate(text, _WIKI, "_" * len(_WIKI))


def normalise_entity(text: Column) -> Column:
    return F.translate(F.lower(text), _ENTITY, "_" * len(_ENTITY))


def sanitise_word(text: Column) -> Column:
    """Characters other than ASCII letters, digits, dot and space become '%', as a LIKE pattern."""
    return F.regexp_replace(text, r"[^a-zA-Z0-9. ]", "%")


def entity_key(link: Column) -> Column:
    """A readable key of a link: its word characters, then the beginning of its hash."""
    return F.concat(F.lit(":"), F.regexp_replace(link, r"[^A-Za-z0-9_]", ""), F.lit("_"), F.substring(F.md5(link), 1, 10))


def provenance(text: Column, inclusive: bool = False) -> Column:
    """DOC:b-e as struct(doc_id, lo, hi), null where malformed; inclusive: the end names the last character."""
    parts = [F.regexp_extract(text, r"^([A-Za-z0-9_.]+):(\d+)-(\d+)$", i) for i in (1, 2, 3)]
    hi = parts[2].try_cast("int") + (1 if inclusive else 0)
    return F.when(parts[0] != "", F.struct(parts[0].alias("doc_id"), parts[1].try_cast("int").alias("lo"), hi.alias("hi")))


def show_provenance(doc_id: Column, lo: Column, hi: Column) -> Column:
    return F.format_string("%s:%d-%d", doc_id, lo, hi)


def parse_span(text: Column) -> Column:
    """b-e as struct(lo, hi), null where malformed."""
    ok = F.regexp_like(text, F.lit(r"^\d+-\d+$"))
    return F.when(ok, F.struct(F.split_part(text, F.lit("-"), F.lit(1)).try_cast("int").alias("lo"), F.split_part(text, F.lit("-"), F.lit(2)).try_cast("int").alias("hi")))


def under_span(text: Column, text_lo: Column, lo: Column, hi: Column) -> Column:
    """The characters of an absolute span in a text that begins at text_lo."""
    return F.substring(text, lo - text_lo + 1, hi - lo)


def unquote(text: Column) -> Column:
    """Percent escapes undone, as far as they are escapes; plus signs stay."""
    kept = F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.url_decode(F.replace(kept, F.lit("+"), F.lit("%2B")))


def plain_spaces(text: Column) -> Column:
    """No-break spaces, also where their UTF-8 bytes were shown as Latin-1, as spaces."""
    return F.replace(F.replace(text, F.lit("Â "), F.lit(" ")), F.lit(" "), F.lit(" "))


def words_unescaped(words: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in TOKENS.items() for x in kv])
    return F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), w))


def team_of(run: Column) -> Column:
    """The part of a run id after its first '_', without the last character."""
    tail = F.regexp_replace(run, r"^[^_]*_", "")
    return F.substring(tail, F.lit(1), F.greatest(F.char_length(tail) - 1, F.lit(0)))


def frequency_bin(n: Column) -> Column:
    return F.when(n.isNull(), None).when(n <= 3, "low").when(n <= 100, "med").otherwise("high")


def parse_score(text: Column) -> Column:
    """(precision,recall,f1) as struct, null where malformed."""
    part = [F.regexp_extract(text, r"^\((\d*\.?\d+),(\d*\.?\d+),(\d*\.?\d+)\)$", i) for i in (1, 2, 3)]
    return F.when(part[0] != "", F.struct(*[p.cast("double").alias(n) for p, n in zip(part, ("precision", "recall", "f1"))]))


def show_score(precision: Column, recall: Column, f1: Column) -> Column:
    return F.concat(F.lit("("), F.concat_ws(",", precision.cast("string"), recall.cast("string"), f1.cast("string")), F.lit(")"))


def whole_range(a: Column, b: Column, n: Column) -> tuple[Column, Column]:
    """A range of fractions (or, beyond 1, of positions; negative ones count from the end) as positions in 0..n."""
    one = lambda x: F.when(F.abs(x) <= 1, F.floor(x * n)).otherwise(F.floor(x))
    wrap = lambda x: F.when(x < 0, x + n).otherwise(x)
    return wrap(one(a)), wrap(one(b))


def partial_date(year: Column, month: Column, day: Column) -> Column:
    """YYYY-MM-DD with X for what is unknown."""
    return F.concat_ws("-", F.coalesce(F.lpad(year.cast("string"), 4, "0"), F.lit("XXXX")), F.coalesce(F.lpad(month.cast("string"), 2, "0"), F.lit("XX")), F.coalesce(F.lpad(day.cast("string"), 2, "0"), F.lit("XX")))


def marked(sentence: Column, s_lo: Column, a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    """A sentence with the subject a between stars and the object b between carets, whichever comes first."""
    cut = lambda lo, hi: F.substring(sentence, lo - s_lo + 1, hi - lo)
    end = s_lo + F.char_length(sentence)

    def one(x_lo, x_hi, x, y_lo, y_hi, y):
        return F.concat(cut(s_lo, x_lo), F.lit(x), cut(x_lo, x_hi), F.lit(x), cut(x_hi, y_lo), F.lit(y), cut(y_lo, y_hi), F.lit(y), cut(y_hi, end))

    return F.when(a_lo <= b_lo, one(a_lo, a_hi, "*", b_lo, b_hi, "^")).otherwise(one(b_lo, b_hi, "^", a_lo, a_hi, "*"))


def question_id(*json_parts: Column) -> Column:
    """SHA-1 of a JSON object written with ', ' and ': ' between its sorted fields."""
    return F.sha1(F.concat(F.lit("{"), F.concat_ws(", ", *json_parts), F.lit("}")))


def histogram_bin(value: Column, edges: list[float]) -> Column:
    """0-based bin of a value, the last bin closed; null outside."""
    out = F.lit(None).cast("int")
    for i in range(len(edges) - 1):
        upper = value <= edges[i + 1] if i == len(edges) - 2 else value < edges[i + 1]
        out = F.when((value >= edges[i]) & upper, i).otherwise(out)
    return out


def unspaced_runs(text: Column) -> Column:
    """The longest runs of letters, marks and digits of scripts without spaces."""
    return F.regexp_extract_all(text, F.lit(f"({UNSPACED}+)"), F.lit(1))


def lexemes(text: Column, singles: bool = True) -> Column:
    """Distinct runs of letters, marks and digits; of scripts without spaces, each two characters that follow each other
    and each character (singles: False keeps only characters that are a run by themselves)."""
    every = lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(1))
    one = every(f"({UNSPACED})") if singles else F.filter(unspaced_runs(text), lambda r: F.char_length(r) == 1)
    return F.array_distinct(F.concat(every(f"({_SPACED}+)"), every(f"(?=({UNSPACED}{{2}}))"), one))
