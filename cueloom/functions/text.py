"""Text functions of captions as column expressions. Offsets and lengths count code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cueloom.functions.wide import RANGES


def _class(points: list[str]) -> str:
    return "".join("-".join(rf"\x{{{p}}}" for p in r.split("-")) for r in points)


#: Inside of a character class, for Java and RE2 alike: two-column characters, and what counts as white space.
WIDE = _class(RANGES.split())
_SPACES = "9-D 1C-20 85 A0 1680 2000-200A 2028 2029 202F 205F 3000".split()
SPACE = _class(_SPACES)
DROPPED_AT_END = "。，、；：.,;:"
PRIMARY_BREAKS, SECONDARY_BREAKS = "。！？….!?", "，、；：,;:"
#: What a rewrite may add or drop without changing the content.
NEUTRAL = rf"{SPACE}，。、；：？！,.;:?!「」『』（）()'\"“”…—\-"


def _all(s: Column | str, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(s, F.lit(pattern), F.lit(by))


def _ascii(s: Column) -> Column:
    return F.octet_length(s) == F.length(s)


#: Wide characters, with one look at most others: all wide ones come after this range begins.
_WIDE = rf"[\x{{1100}}-\x{{10FFFF}}&&[{WIDE}]]"
_WIDE_SOLID = rf"[\x{{1100}}-\x{{10FFFF}}&&[{WIDE}]&&[^{SPACE}]]"


def display_width(s: Column) -> Column:
    """Columns that s takes: two for a wide character, one for any other."""
    return F.length(s) + F.when(_ascii(s), 0).otherwise(F.regexp_count(s, F.lit(_WIDE)))


def is_wide(c: Column) -> Column:
    return F.rlike(c, F.lit(f"^[{WIDE}]$"))


#: White space as characters, for trimming.
SPACES = "".join(chr(c) for r in _SPACES for c in range(int(r.split("-")[0], 16), int(r.split("-")[-1], 16) + 1))


def strip(s: Column) -> Column:
    return F.btrim(s, F.lit(SPACES))


def strip_trailing_punctuation(s: Column) -> Column:
    """s without white space around it, and without stops and commas at its end; question and exclamation marks and ellipses stay."""
    return F.rtrim(F.ltrim(s, F.lit(SPACES)), F.lit(SPACES + DROPPED_AT_END))


def normalize_whitespace(s: Column) -> Column:
    """Runs of white space go between wide characters and become one space elsewhere."""
    joined = F.when(_ascii(s), s).otherwise(_all(s, f"({_WIDE_SOLID})[{SPACE}]+(?={_WIDE_SOLID})", "$1"))
    return _all(joined, rf"\x20[{SPACE}]+|[{SPACE}&&[^\x20]][{SPACE}]*", " ")


def display_text(s: Column) -> Column:
    return strip(normalize_whitespace(s))


def fits(s: Column, width: int) -> Column:
    return display_width(strip_trailing_punctuation(display_text(s))) <= width


def numeric_punctuation(s: Column) -> Column:
    """How many stops and commas stand between two digits (ASCII)."""
    return F.regexp_count(s, F.lit("(?<=[0-9])[.,](?=[0-9])"))


def is_cjk(c: Column) -> Column:
    return F.rlike(c, F.lit(r"^[\x{4E00}-\x{9FFF}]$"))


#: NEUTRAL with one look at most characters: Java keeps a table of single ones below 256, and all others come after one range begins.
_MARKS = "，。、；：？！,.;:?!「」『』（）()'\"“”…—-"
_LOW, _HIGH = ("".join(rf"\x{{{ord(c):X}}}" for c in sorted(SPACES + _MARKS) if (ord(c) < 256) == low) for low in (True, False))
_NEUTRAL_RUN = rf"[{_LOW}[\x{{1680}}-\x{{FFFF}}&&[{_HIGH}]]]+"


def content(s: Column) -> Column:
    """s without white space, punctuation, quotes, brackets and dashes."""
    return _all(s, _NEUTRAL_RUN)


def preview(s: Column, most: int = 120) -> Column:
    one_line = F.replace(strip(s), F.lit("\n"), F.lit(" "))
    return F.when(F.length(one_line) > most, F.concat(F.left(one_line, F.lit(most)), F.lit("..."))).otherwise(one_line)


def audio_name(slide: Column) -> Column:
    return F.format_string("slide_%03d.mp3", slide)


def filter_path(path: Column) -> Column:
    """A path for use inside a media filter: forward slashes, and colons and quotes escaped."""
    return F.replace(F.replace(F.replace(path, F.lit("\\"), F.lit("/")), F.lit(":"), F.lit("\\:")), F.lit("'"), F.lit("\\'"))


def burn_filter(path: Column, font: str = "Noto Sans CJK TC", size: int = 15, margin: int = 1, bar: tuple[int, int] = (650, 38), bottom: int = 40) -> Column:
    """A filter that draws a black bar (of a width and a height, so far above the bottom) and over it, in white, the subtitles of a file."""
    # What the filters of the media program are called, and their options.
    box = f"drawbox=x=(iw-{bar[0]})/2:y=ih-{bottom}:w={bar[0]}:h={bar[1]}:color=black@1:t=fill"
    style = f"FontName={font},FontSize={size},PrimaryColour=&HFFFFFF&,BorderStyle=1,Outline=0,Shadow=0,Alignment=2,MarginV={margin}"
    return F.concat(F.lit(f"{box},subtitles='"), filter_path(path), F.lit(f"':force_style='{style}'"))


def slide_selector(s: Column) -> Column:
    """The slides of a selector such as 6,8-10, ascending; null for one that is empty, malformed or has a range that runs backwards."""
    part = r"\s*[0-9]+\s*(?:-\s*[0-9]+\s*)?"
    numbers = F.transform(F.split(s, ",", -1), lambda p: F.struct(F.trim(F.split_part(p, F.lit("-"), F.lit(1))).try_cast("int").alias("a"), F.coalesce(F.nullif(F.trim(F.split_part(p, F.lit("-"), F.lit(2))), F.lit("")), F.trim(F.split_part(p, F.lit("-"), F.lit(1)))).try_cast("int").alias("b")))
    good = F.rlike(s, F.lit(f"^{part}(?:,{part})*$")) & ~F.exists(numbers, lambda n: F.coalesce(n["a"] > n["b"], F.lit(True)))
    return F.when(good, F.array_sort(F.array_distinct(F.flatten(F.transform(numbers, lambda n: F.sequence(n["a"], n["b"]))))))
