"""Text functions as columns: word tokens, counts, case folding, structure marks, phrases, normalisation, error classes.

The character classes are spelled out, so that they mean the same in every engine and equal the Unicode rules of the
study: words are letters, numbers and underscores; white space is what Unicode calls so, and the four separators U+001C
to U+001F. Exact case folding and NFKD have no built-in counterpart and are vectorised functions.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

# The token rules of the study.
WORD = r"[\p{L}\p{N}_]"
SPACE = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
TOKEN = rf"{WORD}+|[^\p{{L}}\p{{N}}_{SPACE}]"
DIGIT_CHARS = r"[\p{Nd}²³¹⁰⁴-⁹₀-₉①-⑨]"
PROTECTED_FORMS = ("Q", "A")
MARKS = ("Q:", "A:")
REFUSAL = r"(?i)\b(i (do not|don't) know|cannot|can't|unable|no information|not (sure|specified|provided|enough)|sorry|as an ai)\b"
# The same for Java, whose word boundaries heed letters beyond ASCII: here, as in SQL, they don't. SQL ignores case by Unicode's simple
# folding, where ſ is an s and the Kelvin sign a k, but neither İ nor ı is an i; Java either knows no ſ or takes both for an i.
_EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
_REFUSED = REFUSAL.replace("s", "[sſ]").replace("k", "[k\u212a]").replace(r"\b", _EDGE)
# Letters and numbers of Unicode 14 and 15, which SQL knows and Java 17 takes for unassigned.
_LATER = (
    "870-887 889-88e 8b5 8c8-8c9 c5d cdd 170d 171f 1b4c 2c2f 2c5f 9ffd-9fff a7c0-a7c1 a7d0-a7d1 a7d3 a7d5-a7d9 a7f2-a7f4 10570-1057a 1057c-1058a "
    "1058c-10592 10594-10595 10597-105a1 105a3-105b1 105b3-105b9 105bb-105bc 10780-10785 10787-107b0 107b2-107ba 10f70-10f81 11071-11072 11075 1123f-11240 "
    "11740-11746 11ab0-11abf 11f02 11f04-11f10 11f12-11f33 11f50-11f59 12f90-12ff0 1342f 13441-13446 16a70-16abe 16ac0-16ac9 1aff0-1aff3 1aff5-1affb "
    "1affd-1affe 1b11f-1b122 1b132 1b155 1d2c0-1d2d3 1df00-1df1e 1df25-1df2a 1e030-1e06d 1e290-1e2ad 1e4d0-1e4eb 1e4f0-1e4f9 1e7e0-1e7e6 1e7e8-1e7eb "
    "1e7ed-1e7ee 1e7f0-1e7fe 2a6de-2a6df 2b735-2b739 31350-323af"
)
_GAP = r"[^\p{L}\p{N}_[\p{Cn}&&[" + "".join("-".join(rf"\x{{{x}}}" for x in r.split("-")) for r in _LATER.split()) + "]]]+"
MOST_WORDS_OF_AN_ANSWER = 6
MOJIBAKE_MARKS = "√¬Ãâ"
ARTICLES = r"\b(a|an|the)\b"


def tokens(text: Column) -> Column:
    """Words and single punctuation marks, in order."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"{WORD}+"), F.lit(0))


def is_word(form: Column) -> Column:
    return F.rlike(form, F.lit(WORD))


def has_digit(form: Column) -> Column:
    return F.rlike(form, F.lit(r"\p{Nd}"))


def is_protected(form: Column) -> Column:
    """Forms that a compressor may not delete: the marks' letters as written, and anything with a digit."""
    return form.isin(*PROTECTED_FORMS) | has_digit(form)


def fold(text: Column) -> Column:
    """Case folding for the languages at hand, letter by letter; `casefold` is the exact one. Java's lower case depends on what stands
    beside a Σ and makes two characters of an İ, so these are replaced before."""
    single = F.replace(F.replace(text, F.lit("Σ"), F.lit("σ")), F.lit("İ"), F.lit("i"))
    return F.replace(F.lower(single), F.lit("ß"), F.lit("ss"))


def protected_count(text: Column) -> Column:
    """How many words of a text are protected. Every match is a whole word, and has a first group if it is protected."""
    plain = r"[\p{L}\p{N}_&&[^\p{Nd}]]"
    found = F.regexp_extract_all(text, F.lit(rf"((?:{'|'.join(PROTECTED_FORMS)})(?!{WORD})|{plain}*+\p{{Nd}}{WORD}*+)|{WORD}++"), F.lit(1))
    return F.size(F.array_remove(found, ""))


def fold_each(tokens: Column) -> Column:
    """`fold` of each token, at once: none holds a line end, and a line end parts words for any rule of lower case."""
    return F.when(F.size(tokens) > 0, F.split(fold(F.array_join(tokens, "\n")), "\n")).otherwise(tokens)


def ws_count(text: Column) -> Column:
    """Number of words between white space."""
    return F.regexp_count(text, F.lit(f"[^{SPACE}]+"))


def mark_count(text: Column) -> Column:
    return sum(((F.length(text) - F.length(F.replace(text, F.lit(m), F.lit("")))) / len(m) for m in MARKS), F.lit(0)).cast("int")


def digit_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(DIGIT_CHARS))


def line_breaks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def flat(text: Column) -> Column:
    """Punctuation to spaces, lower case, spaces folded: the built-in part of `normalise`. Punctuation goes first, as the lower case of a
    letter too new for SQL may be an old letter."""
    return F.trim(fold(F.regexp_replace(text, _GAP, " ")))


def contains_phrase(text: Column, phrase: Column) -> Column:
    """Whole-word containment of normalised texts; an empty phrase is contained in nothing."""
    pad = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    return (phrase != "") & F.contains(pad(text), pad(phrase))


def error_class(output: Column, normalised: Column, cut_off: Column) -> Column:
    """One of four classes of a wrong answer, tried in this order."""
    n = F.when(normalised == "", 0).otherwise(F.size(F.split(normalised, " ")))
    return (
        F.when(F.coalesce(normalised, F.lit("")) == "", "empty_or_cut")
        .when(cut_off & (n <= 1), "empty_or_cut")
        .when(F.rlike(F.coalesce(output, F.lit("")), F.lit(_REFUSED)), "refusal")
        .when(n > MOST_WORDS_OF_AN_ANSWER, "format")
        .otherwise("wrong_entity")
    )


def alias_list(raw: Column) -> Column:
    """A JSON list as strings; a JSON scalar or a text that is no JSON is a list of one, null and empty an empty list."""
    read = lambda x: F.from_json(x, "array<string>", {"mode": "PERMISSIVE", "maxStringLen": str(2**31 - 1)})
    parsed, trimmed = read(raw), F.trim(raw)
    quoted = F.rlike(F.regexp_replace(trimmed, r"(?s)\\.", ""), F.lit(r'\A"[^"]*"\z')) & (F.length(trimmed) > 2)  # one JSON string, not empty
    scalar = F.try_element_at(read(F.when(quoted, F.concat(F.lit("["), trimmed, F.lit("]")))), F.lit(1))
    one = F.when(F.coalesce(raw, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array(F.coalesce(scalar, raw)))
    return F.when(F.startswith(F.trim(raw), F.lit("[")) & parsed.isNotNull(), F.filter(parsed, lambda a: a.isNotNull())).otherwise(one)


def least_words(aliases: Column) -> Column:
    """White-space words of the shortest alias; null for an empty list."""
    return F.array_min(F.transform(aliases, ws_count))


def slice_by(text: Column, start: Column, end: Column) -> Column:
    """The part of a text between two offsets (code points, end exclusive)."""
    return F.substr(text, start + 1, F.greatest(end - start, F.lit(0)))


def number_or_null(text: Column) -> Column:
    """Digit strings as numbers, anything else as null."""
    return F.when(F.rlike(F.trim(text), F.lit(r"^[0-9]{1,18}$")), F.trim(text).cast("bigint"))


# Bytes of a batch that are Python objects at one time.
PIECE = 1 << 20


def _pieces(values: pa.Array | pa.RecordBatch) -> Iterator:
    """Parts of a batch of at most PIECE bytes, always one row at least."""
    if len(values) > 1 and values.nbytes > PIECE:
        half = len(values) // 2
        yield from _pieces(values.slice(0, half))
        yield from _pieces(values.slice(half))
    elif len(values):
        yield values


def _each(values: pa.Array, make: Callable, kind: pa.DataType) -> pa.Array:
    """make of each value. A batch has as many rows whatever their length, so a worker holds it as Arrow does, and as objects by pieces."""
    return pa.concat_arrays([pa.array([], kind), *(pa.array([make(x) for x in piece.to_pylist()], kind) for piece in _pieces(values))])


def with_forms(df: DataFrame, text: str, forms: dict[str, Callable[[str], str]]) -> DataFrame:
    """df with forms of a text (a plain function each; null for null) in the text's place. Other than the columns below, which are
    returned by whole batches, forms go back by pieces, so that a worker holds none but those of a piece."""
    kept = [f for f in df.schema.fields if f.name != text]
    schema = StructType([*kept, *(StructField(name, StringType()) for name in forms)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _pieces(batch):
                own = [piece.column(f.name) for f in kept]
                made = [pa.array([None if t is None else make(t) for t in piece.column(text).to_pylist()], pa.string()) for make in forms.values()]
                yield pa.RecordBatch.from_arrays([*own, *made], names=schema.names)

    return df.mapInArrow(run, schema)


@F.arrow_udf(StringType())
def casefold(text: pa.Array) -> pa.Array:
    """Exact Unicode case folding."""
    return _each(text, lambda t: None if t is None else t.casefold(), text.type)


def normal_form(text: str) -> str:
    """For comparing answers: compatibility forms, no accents, folded, no punctuation, no English articles, single spaces."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).casefold()
    kept = "".join(c if c.isalnum() or c == "_" else " " for c in plain)
    return " ".join(w for w in kept.split() if w not in ("a", "an", "the"))


@F.arrow_udf(StringType())
def normalise(text: pa.Array) -> pa.Array:
    """`normal_form` of each text."""
    return _each(text, lambda t: None if t is None else normal_form(t), text.type)


@F.arrow_udf(ArrayType(StringType()))
def normalise_list(texts: pa.Array) -> pa.Array:
    """`normalise` of each text of a list."""
    return _each(texts, lambda x: None if x is None else [None if t is None else normal_form(t) for t in x], texts.type)


def _repaired(text: str) -> tuple[str, int]:
    if any(c in text for c in MOJIBAKE_MARKS):
        try:
            new = text.encode("mac_roman").decode("utf-8")
            return new, int(new != text)
        except UnicodeError:
            pass
    return text, 0


@F.arrow_udf(StructType([StructField("text", StringType()), StructField("repaired", IntegerType())]))
def repair_encoding(text: pa.Array) -> pa.Array:
    """Undoes UTF-8 that was read as MacRoman, where a tell-tale character is present; else the text as it is."""
    return _each(text, lambda t: (None, 0) if t is None else _repaired(t), pa.struct([("text", text.type), ("repaired", pa.int32())]))
