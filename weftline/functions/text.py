"""Text functions as native column expressions; the few that Spark cannot express are Arrow UDFs."""

from __future__ import annotations

import itertools
import os.path
import string
import unicodedata
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space between raw tokens, alike in Java and RE2.
RAW = r"[^ \t\n\r\f]+"
_BEGIN_URL = r"(?:https?:(?://|\\\\)|www\.)"


def _one_of(chars: str, negated: bool = False) -> str:
    """A class that names each character by itself: Java looks these up in a table, but tries ranges one after another."""
    return f"[{'^' if negated else ''}{''.join(c if c.isalnum() or c in _BLANK else chr(92) + c for c in sorted(set(chars)))}]"


_BLANK = " \t\n\x0b\f\r"
_AZ = string.ascii_letters + string.digits
_U = _one_of(_AZ + "_:#@%/;$()~?+,-.<=\\&")
_C = _one_of(_BLANK + string.punctuation, negated=True)
URL = rf"{_BEGIN_URL}(?:{_U}++|(?<={_U}#)!)*+"
MAIL = rf"{_one_of(_AZ + '.+_-')}++@{_one_of(_AZ + '._-')}+(?:\.{_one_of(string.ascii_letters)}+)+"
#: Runs of other characters, joined by a stop or comma between digits and by a quote between letters; loops by joints, so a long word takes no deep stack.
WORD = rf"{_C}++(?:(?:(?<=\p{{Nd}})[.,](?=\p{{Nd}})|(?<=\p{{L}})['`](?=\p{{L}})){_C}++)*+"
#: Addresses, then words, then punctuation with a repeated character kept together.
TOKEN = rf"{URL}|{MAIL}|{WORD}|({_one_of(string.punctuation)})\1*"
_P_RE2 = r"!-/:-@\[-`{-~"
_C_RE2 = rf"[^\t\n\x0b\f\r {_P_RE2}]"
#: The same without look-around and back references, for RE2.
TOKEN_RE2 = "|".join(
    [
        rf"{_BEGIN_URL}(?:" + r"[\w:#@%/;$()~_?\+-=\\.&](?:#!)?)*",
        r"[A-Za-z0-9.+_-]+@[A-Za-z0-9._-]+(?:\.[a-zA-Z]+)+",
        rf"(?:\p{{Nd}}(?:[.,]\p{{Nd}})+|\p{{L}}(?:['`]\p{{L}})+|{_C_RE2})+",
        *(f"\\x{c:02x}+" for r in ((33, 48), (58, 65), (91, 97), (123, 127)) for c in range(*r)),
    ]
)
#: Marks that end a sentence.
EOS = (".", "?", "!", "。", ";", "؟", "।", "॥", "…", "!!", "??", "...")
#: Characters of which a closing mark is made, as a class of patterns.
EOS_MARKS = "[.?!;。؟।॥…]"
BEGIN, END = "<begin>", "<end>"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column | str, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` names it, inside lambdas too."""
    return F.transform(F.array(_c(value)), body)[0]


def raw_tokens(text: Column | str) -> Column:
    """Tokens between white space."""
    return F.regexp_extract_all(_c(text), F.lit(RAW), F.lit(0))


def tokenize(text: Column | str, extra: tuple[str, ...] = ()) -> Column:
    """Words, addresses and punctuation; ``extra`` are patterns that take precedence over all others."""
    # the back reference of TOKEN counts groups, of which the extra patterns must have none
    pattern = "|".join([*(f"(?:{x})" for x in extra), TOKEN])
    return F.regexp_extract_all(_c(text), F.lit(pattern), F.lit(0))


tokenise = crude_tokenizer = tokenize


def is_end_of_sentence(token: Column | str) -> Column:
    """Whether a token closes a sentence: a mark, or a cluster of marks."""
    # a look at the first character spares most tokens the pattern
    return F.ascii(_c(token)).isin(*map(ord, EOS_MARKS[1:-1])) & _c(token).rlike(f"^{EOS_MARKS}+$")


def split_sentences(tokens: Column | str) -> Column:
    """Array of sentences; one ends at a closing mark that no other closing mark follows, and the rest is a sentence too."""

    def cut(t: Column) -> Column:
        parts = let(_sentence_ends(t), lambda e: F.zip_with(F.concat(F.array(F.lit(0)), F.slice(e, F.lit(1), F.size(e) - 1)), e, lambda x, y: F.slice(t, x + 1, y - x)))
        return F.when(F.size(t) > 0, parts).otherwise(F.array().cast("array<array<string>>"))

    return let(tokens, cut)


def _sentence_ends(t: Column) -> Column:
    """How many tokens precede each end of a sentence; whether a token is a closing mark is decided once."""
    at = lambda e: F.transform(e, lambda x, i: F.when((i + 1 == F.size(e)) | (x & ~F.get(e, i + 1)), i + 1))
    return F.filter(let(F.transform(t, is_end_of_sentence), at), lambda x: x.isNotNull())


def count_sentences(tokens: Column | str) -> Column:
    """How many sentences :func:`split_sentences` makes; null for null."""
    return F.size(_sentence_ends(_c(tokens)))


def paragraphs(text: Column | str) -> Column:
    """Parts between blank lines."""
    return F.filter(F.split(_c(text), r"\n[ \t]*\n"), lambda x: F.trim(x) != "")


def padded(tokens: Column | str, n: int, begin: str | None = BEGIN, end: str | None = END) -> Column:
    parts = [_c(tokens)]
    if begin is not None and n > 1:
        parts.insert(0, F.array_repeat(F.lit(begin), n - 1))
    if end is not None and n > 1:
        parts.append(F.array_repeat(F.lit(end), n - 1))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def ngrams(tokens: Column | str, n: int, begin: str | None = BEGIN, end: str | None = END) -> Column:
    """Array of all n-grams, each an array, of the tokens with n - 1 markers on either side; None leaves a side bare."""

    def grams(p: Column) -> Column:
        got = F.transform(F.sequence(F.lit(1), F.size(p) - n + 1), lambda i: F.slice(p, i, n))
        return F.when(F.size(p) >= n, got).otherwise(F.array().cast("array<array<string>>"))

    return let(padded(tokens, n, begin, end), grams)


def joined_ngrams(tokens: Column | str, n: int, begin: str | None = BEGIN, end: str | None = END) -> Column:
    """Like :func:`ngrams`, each joined by blanks."""
    return F.transform(ngrams(tokens, n, begin, end), lambda g: F.array_join(g, " "))


def multi_ngrams(tokens: Column | str, low: int = 1, high: int = 9, begin: str | None = BEGIN, end: str | None = END) -> Column:
    """All n-grams of ``low`` to ``high`` tokens, joined by blanks."""
    return F.flatten(F.array(*(joined_ngrams(tokens, n, begin, end) for n in range(low, high + 1))))


def count_ngrams(size: Column, n: int, sides: int = 2) -> Column:
    """How many n-grams ``size`` tokens have."""
    return F.greatest(size - n + 1 + sides * (n - 1), F.lit(0))


def norm_spaces(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(_c(text), r"\s+", " "))


def reflow(text: Column | str, filter_non_text: bool = True) -> Column:
    """Array of lines with wrapped ones joined until a closing mark; an empty line ends a paragraph and stays; a hyphen at a line's end is undone."""
    lines = F.transform(F.split(_c(text), "\n"), lambda x: F.rtrim(F.regexp_replace(x, "\r$", "")))
    if filter_non_text:
        lines = F.filter(lines, lambda x: (F.trim(x) == "") | x.rlike(r"\p{L}"))
    empty = F.array().cast("array<string>")
    zero = F.struct(empty.alias("done"), F.lit("").alias("open"))

    def join(a: Column, x: Column) -> Column:
        return F.when(a == "", x).when(a.rlike(r"\p{L}-$"), F.concat(F.regexp_replace(a, "-$", ""), x)).otherwise(F.concat(a, F.lit(" "), x))

    def step(acc: Column, x: Column) -> Column:
        blank, whole = F.trim(x) == "", join(acc["open"], F.trim(x))
        ends = whole.rlike(r"[.?!;。…]$")
        flush = F.when(acc["open"] != "", F.concat(acc["done"], F.array(acc["open"], F.lit("")))).otherwise(F.concat(acc["done"], F.array(F.lit(""))))
        return F.struct(
            F.when(blank, flush).when(ends, F.concat(acc["done"], F.array(whole))).otherwise(acc["done"]).alias("done"),
            F.when(blank | ends, F.lit("")).otherwise(whole).alias("open"),
        )

    return F.aggregate(lines, zero, step, lambda acc: F.when(acc["open"] != "", F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]))


def calculate_overlap(haystack: Column | str, needle: Column | str, allow_partial: bool = True) -> Column:
    """Array of (part, placement): -1 the needle's end at the haystack's beginning, 0 the needle inside, 1 its beginning at the end, 2 equal.

    A needle inside is not sought at either edge, where partial overlaps are.
    """
    return let(haystack, lambda h: let(needle, lambda n: _overlap(h, n, allow_partial)))


def _overlap(h: Column, n: Column, allow_partial: bool) -> Column:
    kind = "array<struct<part:array<int>,placement:int>>"

    def hit(part: Column, where: int) -> Column:
        return F.struct(part.alias("part"), F.lit(where).alias("placement"))

    short = F.least(F.size(h), F.size(n))
    lengths = F.sequence(F.lit(1), short)
    left = F.transform(F.filter(lengths, lambda k: F.slice(h, F.lit(1), k) == F.slice(n, F.size(n) - k + 1, k)), lambda k: hit(F.slice(h, F.lit(1), k), -1))
    right = F.transform(F.filter(lengths, lambda k: F.slice(n, F.lit(1), k) == F.slice(h, F.size(h) - k + 1, k)), lambda k: hit(F.slice(n, F.lit(1), k), 1))
    inner = F.transform(
        F.filter(F.sequence(F.lit(2), F.greatest(F.size(h) - F.size(n), F.lit(2))), lambda i: (F.size(h) - F.size(n) >= 2) & (F.slice(h, i, F.size(n)) == n)),
        lambda i: hit(F.slice(h, i, F.size(n)), 0),
    )
    none = F.array().cast(kind)
    some = F.concat(left, inner, right) if allow_partial else inner
    return F.when(h == n, F.array(hit(h, 2))).when((F.size(h) == 0) | (F.size(n) == 0), none).otherwise(some)


#: Bytes of text that a worker holds as Python strings at once.
PIECE = 1 << 20


@F.arrow_udf(T.StringType())
def strip_accents(text: pa.Array) -> pa.Array:
    """Decomposed characters with all but ASCII dropped; PIECE bytes at a time, however large the batch."""
    n = pc.binary_length(text).fill_null(0).to_numpy(zero_copy_only=False).astype("int64")
    piece = (n.cumsum() - n) // PIECE
    done, a = [], 0
    while a < len(text):
        b = int(piece.searchsorted(piece[a], side="right"))
        done.append(pa.array([None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore") for x in text.slice(a, b - a).to_pylist()], pa.binary()).cast(pa.string()))
        a = b
    return pa.concat_arrays(done) if done else pa.array([], pa.string())


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def swapped(tokens: pd.Series, distance: pd.Series) -> pd.Series:
    """All orders of the tokens that permute one window of up to ``distance`` + 1 tokens, but the order they have."""

    def one(t: list[str], d: int) -> list[list[str]]:
        t, w, out = tuple(t), min(int(d) + 1, len(t)), {}
        for i in range(len(t) - w + 1):
            for p in itertools.permutations(t[i : i + w]):
                if p != t[i : i + w]:
                    out.setdefault(t[:i] + p + t[i + w :])
        return [list(x) for x in out]

    return pd.Series([None if t is None else one(t, d) for t, d in zip(tokens, distance, strict=True)])


def contexts(tokens: Column | str, keyword: list[str], size: int) -> Column:
    """Array of (at, left, focus, right) for every place where the tokens of ``keyword`` stand; sides have up to ``size`` tokens."""
    return let(tokens, lambda t: _contexts(t, keyword, size))


def _contexts(t: Column, keyword: list[str], size: int) -> Column:
    k, word = len(keyword), F.array(*map(F.lit, keyword))
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.size(t) - k + 1, F.lit(1))), lambda i: F.slice(t, i, k) == word)
    return F.transform(
        places,
        lambda i: F.struct(
            i.alias("at"),
            F.slice(t, F.greatest(i - size, F.lit(1)), F.least(F.lit(size), i - 1)).alias("left"),
            F.slice(t, i, k).alias("focus"),
            F.slice(t, i + k, size).alias("right"),
        ),
    )


def levenshtein_within(a: Column | str, b: Column | str, most: int) -> Column:
    """Edit distance; ``most`` + 1 beyond ``most``."""
    d = F.levenshtein(_c(a), _c(b), most)
    return F.when(d < 0, F.lit(most + 1)).otherwise(d)


def without_common_prefix(df: DataFrame, col: str) -> DataFrame:
    """``df`` with what all texts of a column begin with taken off; one pass, as the least and the greatest text have no more in common than all."""
    ends = df.agg(F.min(col), F.max(col)).first()
    k = len(os.path.commonprefix([x for x in ends if x is not None]))
    return df.withColumn(col, F.substr(col, F.lit(k + 1)))


def matches_at_start(text: Column | str, pattern: str) -> Column:
    return _c(text).rlike(f"^(?:{pattern})")


def parse_time(text: Column | str) -> Column:
    """Milliseconds of HH:MM:SS.mmm or HH:MM:SS:mmm; null if it is neither."""
    p = r"^(\d+):(\d\d):(\d\d)(?:[.:](\d{1,3}))?$"
    g = [F.regexp_extract(_c(text), p, k) for k in range(1, 5)]
    n = [F.when(x == "", F.lit("0")).otherwise(x).cast("long") for x in g]
    ms = F.when(g[3] == "", F.lit("0")).otherwise(F.rpad(g[3], 3, "0")).cast("long")
    return F.when(_c(text).rlike(p), ((n[0] * 60 + n[1]) * 60 + n[2]) * 1000 + ms)


def parse_datetime(text: Column | str) -> Column:
    """Date and time without a zone, of which one that is given is dropped; null if it isn't one."""
    bare = F.regexp_replace(_c(text), r"(?:Z|[+-]\d\d:?\d\d)$", "")
    return F.try_to_timestamp(bare).cast("timestamp_ntz")


def version_at_least(version: Column | str, least: str) -> Column:
    """Compare dotted versions number by number."""
    want = [int(x) for x in least.split(".")]
    have = F.transform(F.split(_c(version), r"\."), lambda x: F.coalesce(F.regexp_extract(x, r"^\d+", 0).try_cast("int"), F.lit(0)))
    have = F.concat(have, F.array_repeat(F.lit(0), len(want)))
    return have >= F.array(*map(F.lit, want))


#: Features by subset, in order of precedence: the classes it knows, and the heads it is limited to.
CGN_FEATURES: tuple[tuple[str, str, str], ...] = (
    ("ntype", "eigen soort", ""),
    ("getal", "ev getal mv", ""),
    ("genus", "fem genus masc onz zijd", ""),
    ("naamval", "bijz dat gen nomin obl stan", ""),
    ("spectype", "achter afgebr afk comment deeleigen enof meta onverst symb vreemd", ""),
    ("conjtype", "neven onder", "VG"),
    ("vztype", "fin init versm", "VZ"),
    ("npagr", "agr agr3 evf evmo evon evz mv rest rest3", "VNW LID"),
    ("lwtype", "bep onbep", "LID"),
    ("vwtype", "aanw betr bez excl onbep pers pr recip refl vb vrag", "VNW"),
    ("pdtype", "adv-pron det grad pron", "VNW"),
    ("status", "nadr red vol", "VNW"),
    ("persoon", "1 2 2b 2v 3 3m 3o 3p 3v persoon", "VNW"),
    ("npagr", "agr evon rest", ""),
    ("positie", "nom postnom prenom vrij", ""),
    ("buiging", "met-e met-s zonder", ""),
    ("getal-n", "mv-n zonder-n zonder-v", ""),
    ("graad", "basis comp dim sup", ""),
    ("wvorm", "inf od pv vd", "WW"),
    ("pvtijd", "conj tgw verl", "WW"),
    ("pvagr", "ev met-t mv", "WW"),
    ("numtype", "hoofd rang", "TW"),
    ("dial", "dial", ""),
)


def cgn_tag(tag: Column | str) -> Column:
    """(head, features) of a tag like ``N(soort,ev)``; a feature is (subset, class), the subset the first that knows the class for that head."""
    head = F.regexp_extract(_c(tag), r"^([^(]+)", 1)
    inside = F.regexp_extract(_c(tag), r"\(([^)]*)\)", 1)
    values = F.filter(F.split(inside, ","), lambda x: F.trim(x) != "")

    def subset(x: Column) -> Column:
        out = None
        for name, known, heads in CGN_FEATURES:
            cond = x.isin(*known.split())
            if heads:
                cond = cond & head.isin(*heads.split())
            out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
        return out

    return F.struct(head.alias("head"), F.transform(values, lambda x: F.struct(subset(F.trim(x)).alias("subset"), F.trim(x).alias("cls"))).alias("feats"))
