"""String functions of the extraction stages as column expressions; Arrow functions only where Spark has no built-in (Unicode forms)."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

#: Blocks of Japanese characters.
CJK = r"　-〿぀-ヿ㐀-䶿一-鿿＀-￯"
# Small kana and what they fold to.
SMALL_KANA = ("ァィゥェォッャュョヮヵヶ", "アイウエオツヤユヨワカケ")
FULL_DIGITS = "０１２３４５６７８９"
# Control characters that no text keeps; marks of scanned booklets and the one mark they become; what
# reprints may print differently, as (characters, what stands for them).
CONTROLS = r"\x00-\x08\x0b-\x1f\x7f"
BOOKLET_MARKS = {"，": "、､", "。": "｡", "—": "―", "〜": "~"}
REPRINT_MARKS = (("，、,", "，"), ("。．.", "。"), ("“”\"'`´‘’", ""), ("（）()〔〕[]「」【】", ""), ("-–—ー−~〜", ""))


@F.pandas_udf(StringType())
def nfc(text):  # noqa: ANN001, ANN202
    """Canonical composition."""
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))


@F.pandas_udf(StringType())
def nfkc(text):  # noqa: ANN001, ANN202
    """Compatibility composition."""
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


@F.pandas_udf(IntegerType())
def display_width(text):  # noqa: ANN001, ANN202
    """Columns on screen: wide, full-width and ambiguous characters take two."""
    return text.map(lambda s: None if s is None else sum(2 if unicodedata.east_asian_width(c) in "WFA" else 1 for c in s)).astype("Int32")


def one_of(characters: str) -> str:
    """A class of single characters."""
    return "[" + "".join(f"\\{c}" if c in "[]\\^-&" else c for c in characters) + "]"


def tidy_blanks(s: Column) -> Column:
    """Control characters dropped (tab and line feed stay), blanks collapsed, none beside line feeds or at the ends."""
    lines = F.split(F.regexp_replace(s, f"[{CONTROLS}]", ""), "\n")
    tidy = F.transform(lines, lambda line: F.trim(F.regexp_replace(line, "[ \t　\u00a0]+", " ")))
    return F.trim(F.array_join(tidy, "\n", ""), F.lit(" \n"))


def clean(s: Column) -> Column:
    """Composed and with tidy blanks."""
    return tidy_blanks(nfc(s))


def strip_readings(s: Column, pairs: list[tuple[str, str]]) -> Column:
    """Readings printed before their base, or left alone on a line, dropped: one pass over the text for all pairs."""
    if not pairs:
        return s
    alone = "|".join(dict.fromkeys(reading for reading, _ in pairs))
    before = "|".join(rf"{reading}\s*({base})\s*" for reading, base in pairs)
    # only the group of the pair that matched holds a text
    return F.regexp_replace(s, rf"(?m)^[ \t]*(?:{alone})[ \t]*$\n?|{before}", "".join(f"${k + 1}" for k in range(len(pairs))))


def booklet(s: Column) -> Column:
    """The form of scanned booklets: one comma, one stop, one dash, no blanks beside Japanese characters."""
    marks = [(c, mark) for mark, some in BOOKLET_MARKS.items() for c in some]
    s = F.translate(tidy_blanks(s), "".join(c for c, _ in marks), "".join(m for _, m in marks))
    return F.trim(F.regexp_replace(s, rf"(?<=[{CJK}]) +| +(?=[{CJK}])", ""))


def _folded(s: Column) -> Column:
    s = F.translate(F.lower(s), *SMALL_KANA)
    for characters, mark in REPRINT_MARKS:
        s = F.regexp_replace(s, one_of(characters), mark)
    return F.regexp_replace(s, r"(?U)\s+", "")


def canonical(s: Column) -> Column:
    """What reprints of one question share: width, case, small kana, commas, stops, quotes, brackets, dashes and blanks folded."""
    return _folded(nfkc(s))


def canonical_plain(s: Column) -> Column:
    """`canonical` without the compatibility step, for text of one width."""
    return _folded(s)


def digits(s: Column) -> Column:
    """A number in half or full-width digits."""
    return F.translate(s, FULL_DIGITS, "0123456789").try_cast("int")


def rate_of(s: Column) -> Column:
    """The examiners' rating in a commentary; qualified phrases go before plain ones."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed((("やや低", "やや低"), ("やや高", "やや高"), ("平均", "平均的"), ("低", "(?:低|高くなかった)"), ("高", "高"))):
        out = F.when(s.rlike(f"正答率[^。]{{0,8}}{pattern}"), name).otherwise(out)
    return out


def seam(a: Column, b: Column) -> Column:
    """Two lines joined, with a blank only between ASCII letters or digits."""
    return F.concat(a, F.when(a.rlike("[A-Za-z0-9]$") & b.rlike("^[A-Za-z0-9]"), " ").otherwise(""), b)


def bracket_gaps(s: Column, opens: str, closes: str) -> Column:
    """Closing brackets without an opening one, list markers such as a) left out."""
    probe = F.regexp_replace(s, r"(?m)(?:^|[ 　])[A-Za-z0-9ア-ン]{1,2}[)）]", "")
    return F.greatest(F.lit(0), F.regexp_count(probe, F.lit(f"[{closes}]")) - F.regexp_count(probe, F.lit(f"[{opens}]")))


def paragraphs(s: Column) -> Column:
    """Lines that are not empty."""
    return F.filter(F.split(s, "\n"), lambda x: x != "")


def preview(s: Column, size: int) -> Column:
    """The first `size` characters and an ellipsis if there are more."""
    return F.when(F.length(s) > size, F.concat(F.substring(s, 1, size), F.lit("…"))).otherwise(s)
