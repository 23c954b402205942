"""Text scalars as Column expressions.

Everything stays in the JVM except full Unicode normalisation, which is sent to Python only for
the rows holding a character whose folding is not a plain lower-casing.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliary import params as P

# The characters Python's str.strip() removes.
PY_BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)

# The CJK blocks that are indexed by character n-grams.
CJK = "\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
# Dotless i belongs to the case-insensitive Latin class.
LATIN = "a-z0-9\u0131"

# Question words that never become query terms.
STOP_TERMS = (
    "一下", "一个", "什么", "信息", "内容", "哪个", "哪些", "哪天", "哪里", "多少", "如何",
    "怎么", "情况", "我想", "文件", "文档", "是否", "有关", "材料", "查找", "相关", "给出",
    "请问", "资料", "这个", "那个", "里面", "项目",
)

# Whole-message social patterns, tried in this order.
SMALL_TALK = (
    (
        "greeting",
        "(?:(?:你|您)好|哈+喽+|哈+啰+|嗨+|在吗|有人吗|早上好|上午好|下午好|晚上好|早安|午安|晚安|"
        "hello|hi|hey)(?:呀|啊|哇|哦|啦|呢)?[!！?？。,.，~～]*",
    ),
    (
        "thanks",
        r"(?:谢谢|多谢|感谢|辛苦了|thanks|thank\s+you)(?:你|您|啦|了|呀|啊)?[!！。,.，~～]*",
    ),
    ("farewell", "(?:再见|拜拜|回头见|下次见|bye|goodbye)(?:啦|了|呀|啊)?[!！。,.，~～]*"),
    (
        "capability",
        "(?:你是谁|您是谁|你叫什么|您叫什么|你能做什么|你可以做什么|怎么使用你|如何使用你)[?？!！。]*",
    ),
)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(PY_BLANKS))


def lstrip(text: Column) -> Column:
    return F.ltrim(text, F.lit(PY_BLANKS))


def is_blank(text: Column) -> Column:
    return text.isNull() | (F.length(strip(text)) == 0)


def normalize_newlines(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def normalize_markdown(text: Column) -> Column:
    """Unix line ends, outer blanks removed."""
    return strip(normalize_newlines(text))


# Blocks checked for plainly folding characters: Latin, Greek and Cyrillic, general punctuation,
# CJK punctuation and kana, CJK ideographs, full-width ASCII.
_FOLD_BLOCKS = (
    (0x0000, 0x024F),
    (0x0370, 0x052F),
    (0x2010, 0x2027),
    (0x3000, 0x30FF),
    (0x3400, 0x4DBF),
    (0x4E00, 0x9FFF),
    (0xFF01, 0xFF5E),
)


@lru_cache(maxsize=1)
def _plain_fold_ranges() -> list[tuple[int, int]]:
    """Code point ranges of the characters that fold to their lower-case form.

    Derived from the Unicode tables: a character qualifies when NFKC leaves it alone, it cannot
    combine with a neighbour, and its case folding is its lower case (sharp s is handled apart).
    Full-width ASCII qualifies too because it maps one to one (see `_fold_native`).
    """

    def plain(char: str) -> bool:
        if "\uff01" <= char <= "\uff5e" or char in "\u3000\u00df":
            return True
        if char == "\u03a3" or unicodedata.category(char) in ("Cn", "Mn", "Mc", "Me"):
            return False
        return (
            unicodedata.normalize("NFKC", char) == char
            and char.casefold() == char.lower()
            and len(char.lower()) == 1
        )

    ranges: list[tuple[int, int]] = []
    for low, high in _FOLD_BLOCKS:
        start = None
        for code in range(low, high + 2):
            if code <= high and plain(chr(code)):
                start = code if start is None else start
            elif start is not None:
                ranges.append((start, code - 1))
                start = None
    return ranges


#: A look ahead, so that a search through a text tries what follows on characters beyond ASCII alone.
BEYOND_ASCII = r"(?=[^\x00-\x7f])"


def _outside(ranges: list[tuple[int, int]]) -> str:
    # One plain range settles an ASCII character; the whole class is tried on the others alone.
    return BEYOND_ASCII + "[^" + "".join(f"\\u{low:04x}-\\u{high:04x}" for low, high in ranges) + "]"


def _needs_python(text: Column) -> Column:
    """Some character does not fold plainly.

    The few wide ranges settle nearly every text; only the rest is tried against all ranges, which
    is slow as one character class.
    """
    ranges = _plain_fold_ranges()
    wide = [r for r in ranges if r[1] - r[0] >= 90]
    return text.rlike(_outside(wide)) & text.rlike(_outside(ranges))


def let(value: Column, body) -> Column:
    """`body(value)` with the value computed once per row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _fold_native(text: Column) -> Column:
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "\u3000"
    narrow = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "
    narrowed = F.when(
        text.rlike(BEYOND_ASCII + "[\uff01-\uff5e\u3000]"), F.translate(text, wide, narrow)
    ).otherwise(text)
    return F.replace(F.lower(narrowed), F.lit("\u00df"), F.lit("ss"))


@F.pandas_udf(T.StringType())
def _fold_python(text: pd.Series) -> pd.Series:
    return text.map(
        lambda value: unicodedata.normalize("NFKC", value).casefold(), na_action="ignore"
    ).astype(object)


def lexical_normalize(text: Column) -> Column:
    """NFKC followed by full case folding.

    Rows made only of plainly folding characters are lower-cased in the JVM; the Python function
    sees null for them and the text itself only for the rest.
    """
    plain_ascii = F.octet_length(text) == F.length(text)
    odd = ~plain_ascii & _needs_python(text)
    folded = _fold_python(F.when(odd, text))
    return F.when(plain_ascii, F.lower(text)).otherwise(F.coalesce(folded, _fold_native(text)))


def folded_terms(folded: Column) -> Column:
    """Lexical terms, in order and with repeats, of already normalised text.

    One regular expression yields Latin runs of two or more (cut at 200) and single digits, and
    whole CJK runs; only texts that do hold CJK pay for the n-gram expansion.
    """
    token = f"([{LATIN}]{{2,200}}|[0-9]|[{CJK}]+)(?:(?<=[{LATIN}])[{LATIN}]+)?"
    tokens = F.regexp_extract_all(folded, F.lit(token), F.lit(1))

    def grams(run: Column, size: int) -> Column:
        count = F.length(run) - (size - 1)
        return F.when(
            count > 0,
            F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.substring(run, i, F.lit(size))),
        ).otherwise(F.array().cast("array<string>"))

    def expand(run: Column) -> Column:
        whole = F.when(F.length(run) <= 8, F.array(run)).otherwise(F.array().cast("array<string>"))
        return F.when(
            run.rlike(f"^[{CJK}]{{2,}}"), F.concat(grams(run, 2), grams(run, 3), whole)
        ).otherwise(F.array(run))

    cjk = (F.octet_length(folded) != F.length(folded)) & folded.rlike(f"{BEYOND_ASCII}[{CJK}]")
    return F.when(cjk, F.flatten(F.transform(tokens, expand))).otherwise(tokens)


def lexical_terms(text: Column) -> Column:
    """Terms of raw text: Latin words and numbers, CJK bigrams, trigrams and short runs."""
    return let(lexical_normalize(text), folded_terms)


def index_terms(text: Column) -> Column:
    """Ordered distinct lexical terms."""
    return F.array_distinct(lexical_terms(text))


def plain_index_terms(text: Column) -> Column:
    """`index_terms` of a text made only of plainly folding characters, null for any other; nothing is sent to Python."""
    plain_ascii = F.octet_length(text) == F.length(text)
    folded = F.when(plain_ascii, F.lower(text)).when(~_needs_python(text), _fold_native(text))
    return F.array_distinct(let(folded, folded_terms))


def query_terms(text: Column) -> Column:
    """Ordered distinct terms without stop terms, at most 48."""
    kept = F.array_except(index_terms(text), F.array(*[F.lit(t) for t in STOP_TERMS]))
    return F.slice(kept, 1, P.QUERY_TERM_LIMIT)


def estimate_tokens(text: Column) -> Column:
    """Conservative token count: one token per three UTF-8 bytes, rounded up."""
    return F.ceil(F.octet_length(text) / F.lit(3)).cast("int")


def json_string_bytes(text: Column) -> Column:
    """UTF-8 length of the text once quoted as a JSON string."""
    return F.octet_length(F.to_json(F.struct(text.alias("v")))) - 6


def json_string(text: Column) -> Column:
    """The text quoted as a JSON string."""
    whole = F.to_json(F.struct(text.alias("v")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def evidence_tokens(text: Column) -> Column:
    """Token estimate of the text as it is embedded in a JSON request."""
    return F.ceil(json_string_bytes(text) / F.lit(3)).cast("int")


def request_tokens(prompt: Column, schema_text: Column) -> Column:
    """Token estimate of a structured request: prompt, schema and fixed overhead."""
    return estimate_tokens(prompt) + estimate_tokens(schema_text) + F.lit(P.SCHEMA_OVERHEAD_TOKENS)


def has_meaningful_text(body: Column) -> Column:
    """At least 40 letters, digits, underscores or CJK characters outside page headings."""
    rest = F.regexp_replace(body, r"(?im)^##\s+Page\s+\d+\s*$", "")
    return F.regexp_count(rest, F.lit(r"[\p{L}\p{N}_\x{3400}-\x{9fff}]")) >= 40


def small_talk_kind(text: Column) -> Column:
    """greeting / thanks / farewell / capability when the whole message is social, else null."""
    squeezed = strip(F.regexp_replace(text, f"[{PY_BLANKS}]+", " "))
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(SMALL_TALK):
        kind = F.when(squeezed.rlike(f"(?iu)^(?:{pattern})$"), F.lit(name)).otherwise(kind)
    return kind


def canonical_document_id(text: Column) -> Column:
    """The id as a long when it is written canonically (1 .. 2^63-1), else null."""
    return F.when(text.rlike("^[1-9][0-9]{0,18}$"), text.try_cast("long"))


def source_modified_at(mtime_ns: Column) -> Column:
    """Nanosecond epoch as a timestamp."""
    return F.timestamp_micros(F.call_function("div", mtime_ns, F.lit(1000)))
