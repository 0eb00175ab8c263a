"""Text, number and key expressions (all `Column -> Column`, no UDF)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Full-width characters that are narrowed on ingest.
FULL_WIDTH = "０１２３４５６７８９ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺ"
HALF_WIDTH = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Spellings that mean "yes".
TRUE_WORDS = ["1", "true", "True", "TRUE", "是", "有", "Y", "yes"]

# Unicode white space: Java needs (?U) to see U+3000, and the four C0 separators by hand.
WHITE = r"(?U)[\s\x1c-\x1f]"

# Ends that are printable ASCII other than the blank, or a common CJK character, are no white space.
FIRM_ENDS = [("!", "~"), ("\u4e00", "\u9fff")]


def missing_to_null(c: Column) -> Column:
    """Empty text is a missing value. `c` is computed once."""
    return F.nullif(c, F.lit(""))


def _firm_ends(c: Column) -> Column:
    """The text surely begins and ends with something else than white space."""
    ends = [F.left(c, F.lit(1)), F.right(c, F.lit(1))]
    return reduce(lambda x, y: x & y, [reduce(lambda x, y: x | y, [e.between(*r) for r in FIRM_ENDS]) for e in ends])


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, rf"{WHITE}+\z|\A{WHITE}+", "")


def strip(c: Column) -> Column:
    """White space at the ends goes. Most texts have none: the pattern runs for the others only."""
    text = c.cast("string")
    return F.when(_firm_ends(text), text).otherwise(_trimmed(text))


def strip_or_null(c: Column) -> Column:
    return missing_to_null(strip(c))


def collapse_space(c: Column) -> Column:
    """Every run of white space becomes one blank; the ends are trimmed."""
    return F.trim(squeezed(c))


def clean_text(c: Column) -> Column:
    """Narrow full-width digits and capitals, collapse white space; missing stays NULL.

    Texts of printable ASCII and common CJK characters, with single blanks inside at most, are clean already.
    """
    c = c.cast("string")
    clean = _firm_ends(c) & ~c.contains("  ") & ~c.rlike(r"[^ -~\x{4e00}-\x{9fff}]")
    return F.when(clean, c).otherwise(missing_to_null(collapse_space(F.translate(c, FULL_WIDTH, HALF_WIDTH))))


def number_in(c: Column) -> Column:
    """The first signed run of digits of a cleaned text."""
    return F.regexp_extract(c, r"-?\d+", 0).try_cast("bigint")


def first_int(c: Column) -> Column:
    """The first signed run of digits in the text ("about 12 people" -> 12)."""
    return number_in(clean_text(c))


def strict_int(c: Column) -> Column:
    """The whole text as an integer, else NULL ("12.5" -> NULL)."""
    return strip(c.cast("string")).try_cast("bigint")


def float_int(c: Column) -> Column:
    """Number text cut to its whole part ("12.5" -> 12)."""
    return strip(c.cast("string")).try_cast("double").try_cast("bigint")


def to_float(c: Column) -> Column:
    return strip(c.cast("string")).try_cast("double")


def int_or_last(c: Column, last: int = 999999999) -> Column:
    """Sort key: numbers by value, missing numbers after them."""
    return F.coalesce(first_int(c), F.lit(last).cast("bigint"))


def is_yes(c: Column) -> Column:
    """1 for a cleaned text that means "yes", else 0."""
    return F.when(c.isin(TRUE_WORDS), F.lit(1)).otherwise(F.lit(0))


def bool_int(c: Column) -> Column:
    return is_yes(clean_text(c))


def clean_html(c: Column) -> Column:
    """<br> becomes a line break, other tags go, blank lines go. Missing stays NULL.

    One line of printable ASCII and common CJK characters without tags stays as it is.
    """
    c = c.cast("string")
    plain_line = _firm_ends(c) & ~c.rlike(r"[^ -;=-~\x{4e00}-\x{9fff}]")
    broken = F.regexp_replace(_trimmed(c), r"(?i)<br(?U)\s*/?>", "\n")
    plain = F.regexp_replace(broken, r"<[^>]+>", "")
    lines = F.transform(F.split(plain, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"), _trimmed)
    return F.when(plain_line, c).otherwise(missing_to_null(F.array_join(F.filter(lines, lambda x: x != ""), "\n")))


def json_compact(c: Column) -> Column:
    """Compact JSON; NULL for NULL and for empty arrays and maps."""
    text = F.to_json(c)
    return F.when(~text.isin("[]", "{}", '""'), text)


def composite_key(parts: dict[str, Column], sep: str = "|") -> Column:
    """`a=1|b=2`; a missing part is written as empty text."""
    pieces = [F.concat(F.lit(f"{name}="), F.coalesce(value.cast("string"), F.lit(""))) for name, value in parts.items()]
    return F.concat_ws(sep, *pieces)


def joined_key(*parts: Column, sep: str = "|") -> Column:
    return F.concat_ws(sep, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def school_id_from_issue(record_key: Column, raw_value: Column) -> Column:
    """The school id named by an issue: `school_id=..` of the key, else a leading number of the raw value."""
    keyed = F.regexp_extract(record_key, r"(?:^|\|)school_id=([^|]*)", 1)
    has_key = record_key.rlike(r"(?:^|\|)school_id=")
    lead = strip(F.split(raw_value, " ", 2)[0])
    return F.when(has_key, strip_or_null(keyed)).otherwise(F.when(lead.rlike(r"^\d+$"), lead))


def combined_raw_value(raw_value: Column, record_key: Column, limit: int | None = None) -> Column:
    """Raw value and record key as one text; `limit` cuts it for display."""
    raw, key = missing_to_null(raw_value), missing_to_null(record_key)
    whole = F.coalesce(F.concat_ws(" | ", raw, key), F.lit(""))
    return whole if limit is None else F.substring(whole, 1, limit)


def issue_type_std(c: Column) -> Column:
    """`missing` when empty, otherwise the first 50 characters."""
    return F.substring(F.coalesce(strip_or_null(c), F.lit("missing")), 1, 50)


def null_add(a: Column, b: Column) -> Column:
    """Sum that ignores a missing side."""
    return F.coalesce(a + b, a, b)


def unique_key(c: Column, kind: str) -> Column:
    """A NULL-free form of a key column: 0 for ids, '' for text."""
    return F.coalesce(c, F.lit(0).cast("bigint") if kind == "id" else F.lit(""))


def batch_from_path(path: Column, prefix: str) -> Column:
    """Batch id from `.../<prefix><batch>.csv` or from `.../<batch>/school_list/school_list.json`."""
    from_csv = F.regexp_extract(path, rf"(?:^|/){prefix}([^/]*)\.csv$", 1)
    from_json = F.regexp_extract(path, r"([^/]+)/school_list/[^/]+\.json$", 1)
    return F.coalesce(missing_to_null(from_csv), missing_to_null(from_json))


def batch_time(batch: Column) -> Column:
    """`yyyyMMdd_HHmmss` as a timestamp, NULL when it is something else."""
    shaped = F.when(batch.rlike(r"^\d{8}_\d{6}$"), batch)
    return F.try_to_timestamp(shaped, F.lit("yyyyMMdd_HHmmss"))


def bound(c: Column, use: Callable[[Column], Column]) -> Column:
    """`use(c)` with `c` evaluated once, however often `use` mentions it."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def text_chunks(c: Column, size: int = 520, overlap: int = 80) -> Column:
    """Overlapping pieces of the whole text; one piece when it is short enough."""

    def cut(t: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.length(t) - 1, F.lit(0)), F.lit(size - overlap))
        many = F.transform(starts, lambda s: F.substring(t, s + 1, F.lit(size)))
        return F.when(F.length(t) <= size, F.array(t)).otherwise(many)

    return bound(c, cut)


def occurrences(text: Column, keyword: Column) -> Column:
    """Number of non-overlapping occurrences."""
    gone = F.length(text) - F.length(F.replace(text, keyword, F.lit("")))
    return F.when(F.length(keyword) > 0, (gone / F.length(keyword)).cast("int")).otherwise(F.lit(0))


def keyword_hits(text: Column, keywords: Column) -> Column:
    """Occurrences of all keywords of an array, added up."""
    return F.aggregate(keywords, F.lit(0), lambda acc, k: acc + occurrences(text, k))


def top_chunk(chunks: Column, keywords: Column) -> Column:
    """Struct(score, back, chunk) of the first chunk with the most hits, also when nothing hits."""
    scored = F.transform(
        chunks, lambda ch, i: F.struct(keyword_hits(ch, keywords).alias("score"), (-i).alias("back"), ch.alias("chunk"))
    )
    return F.array_max(scored)


def best_chunk(text: Column, keywords: Column, size: int = 520, overlap: int = 80) -> Column:
    """Struct(score, chunk) of the first chunk with the most hits; NULL when nothing hits."""
    top = top_chunk(text_chunks(squeezed(text), size, overlap), keywords)
    return bound(top, lambda t: F.when(t["score"] > 0, F.struct(t["score"].alias("score"), t["chunk"].alias("chunk"))))


def squeezed(c: Column) -> Column:
    """Every run of white space becomes one blank; the ends stay."""
    return F.regexp_replace(c, rf"{WHITE}+", " ")


def snippet(c: Column, limit: int = 220) -> Column:
    """White space collapsed; longer text is cut and ends with an ellipsis."""

    def cut(t: Column) -> Column:
        return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.substring(t, 1, limit - 1), F.lit("…")))

    return bound(F.coalesce(collapse_space(c), F.lit("")), cut)


def file_matches(file_name: Column, school: Column, major: Column, year: Column) -> Column:
    """A file belongs to a candidate by school name, or by major (and year, when one is given)."""

    def squeeze(c: Column) -> Column:
        return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), rf"{WHITE}+", "")

    name, s, m, y = squeeze(file_name), squeeze(school), squeeze(major), squeeze(year)
    by_school = (s != "") & name.contains(s)
    by_major = (m != "") & name.contains(m) & ((y == "") | name.contains(y))
    return by_school | by_major


def readable_category(c: Column) -> Column:
    """Has a CJK character and no sign of broken decoding."""
    text = strip(c)
    good = text.rlike(r"[\x{4e00}-\x{9fff}]")
    bad = text.rlike(r"[\x{fffd}\x{a0}-\x{ff}]")
    return F.coalesce(good & ~bad, F.lit(False))


def any_contains(text: Column, words: list[str]) -> Column:
    """True when the text contains one of the words."""
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])
