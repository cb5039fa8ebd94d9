"""Column functions for noisy text: cleaning, names, money, flags, paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Characters dropped from names, and label affixes, in matching order.
APOSTROPHES = "'`"
NAME_PUNCTUATION = ".,;:-"
SQUASHED = "- ."
DASHES = ("-", "—", "–")
PARISH_PREFIXES = ("parish of ", "parish ")
PARISH_SUFFIXES = (" (part of)", " (part of.)", " part of", "—continued", " continued")
PENCE_PER_POUND = 240
PENCE_PER_SHILLING = 12
PAGE_NAME_PATTERN = r"(?i)^[A-Z]+_[A-Z]+_\d+_\d+\.jpe?g$"
PAGE_NUMBER = r"(\d+)_(\d+)\.[A-Za-z]+$"
IMAGE_SUFFIX_PATTERN = r"(?i)\.jpe?g$"
COMMENT_OR_BLANK = r"(?U)^\s*(#.*)?$"

_EDGE_SPACE = r"(?U)^\s+|\s+$"
_EDGE_SPACE_OR_NAN = r"(?U)^\s*(?i:nan)?\s*$|^\s+|\s+$"
_SPACE_RUN = r"(?U)\s+"
_WHOLE_NUMBER = r"^[+-]?[0-9]+$"
# The name between an optional prefix and the suffixes; those taken off last stand first.
_PARISH_FRAME = (
    "^(?:" + "|".join(PARISH_PREFIXES) + ")?(.*?)"
    + "".join(rf" ?(?:\Q{suffix}\E)?" for suffix in reversed(PARISH_SUFFIXES))
    + "$"
)


_PLAIN_AMOUNT = r"^[0-9]{1,15} [0-9]{1,15} [0-9]{1,15}\z"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _no_edge_space(text: Column) -> Column:
    """Whether a text is empty or starts and ends with a visible ASCII character; most texts do, and need no pattern."""
    ends = [F.ascii(F.substring(text, at, 1)).between(33, 126) for at in (1, -1)]
    return (text == "") | (ends[0] & ends[1])


def with_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are evaluated once a row: no later step can pull their expressions over the generator."""
    made = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(made)))


def trim_text(c: Column | str) -> Column:
    """Trim every kind of Unicode white space; null becomes ''."""
    text = F.coalesce(_col(c).cast("string"), F.lit(""))
    return F.when(_no_edge_space(text), text).otherwise(F.regexp_replace(text, _EDGE_SPACE, ""))


def clean_key(c: Column | str) -> Column:
    """null, blank and the text 'nan' become ''; case and punctuation stay."""
    text = F.coalesce(_col(c).cast("string"), F.lit(""))
    plain = _no_edge_space(text) & (F.lower(text) != "nan")
    return F.when(plain, text).otherwise(F.regexp_replace(text, _EDGE_SPACE_OR_NAN, ""))


def is_filled(c: Column | str) -> Column:
    """neither null, blank nor 'nan'."""
    return clean_key(c) != ""


def prefer(first: Column | str, second: Column | str) -> Column:
    """the first filled value, trimmed, else ''."""
    return F.coalesce(F.nullif(clean_key(first), F.lit("")), clean_key(second))


def normalise_name(c: Column | str, apostrophes: str = APOSTROPHES) -> Column:
    """lower case, no apostrophes, punctuation or hyphens, single spaces."""
    bare = F.translate(F.lower(F.coalesce(_col(c).cast("string"), F.lit(""))), apostrophes + NAME_PUNCTUATION, "")
    return F.trim(F.regexp_replace(bare, _SPACE_RUN, " "))


def normalise_parish(c: Column | str) -> Column:
    """F10 without the leading label and the trailing part/continued marks."""
    return F.trim(F.regexp_replace(normalise_name(c), _PARISH_FRAME, "$1"))


def squash(c: Column | str) -> Column:
    """upper case without hyphens, spaces and full stops."""
    return F.translate(F.upper(_col(c)), SQUASHED, "")


def to_int(c: Column | str, default: int) -> Column:
    """whole number, else the default."""
    text = trim_text(c)
    return F.coalesce(F.when(text.rlike(_WHOLE_NUMBER), text.try_cast("int")), F.lit(default))


def to_number(c: Column | str) -> Column:
    """number, else 0."""
    return F.coalesce(_col(c).try_cast("double"), F.lit(0.0))


def to_pence(c: Column | str, strip_currency: bool = True) -> Column:
    """text 'pounds shillings pence' to whole pence.

    ``strip_currency`` also reads amounts that carry a pound sign; without it
    the sign counts as a token (or spoils one).
    """
    text = F.coalesce(_col(c).cast("string"), F.lit(""))
    if strip_currency:
        text = F.translate(text, "£", " ")
    tokens = F.array_remove(F.split(text, _SPACE_RUN), "")

    def share(token: Column, weight: Column) -> Column:
        digits = F.translate(token, ",", "")
        number = F.coalesce(F.when(digits.rlike(_WHOLE_NUMBER), digits.try_cast("bigint")), F.lit(0))
        # further tokens have no weight; a missing one makes the amount null
        return F.when(weight.isNull(), F.lit(0)).when(token.isNotNull(), number * weight).cast("bigint")

    weights = F.array(*[F.lit(w).cast("bigint") for w in (PENCE_PER_POUND, PENCE_PER_SHILLING, 1)])
    parts = F.zip_with(tokens, weights, share)
    any_form = F.coalesce(F.aggregate(parts, F.lit(0).cast("bigint"), lambda total, part: total + part), F.lit(0))
    raw = _col(c).cast("string")
    three = (F.substring_index(raw, " ", 1), F.substring_index(F.substring_index(raw, " ", 2), " ", -1), F.substring_index(raw, " ", -1))
    pounds, shillings, pence = (t.try_cast("bigint") for t in three)
    plain = pounds * F.lit(PENCE_PER_POUND).cast("bigint") + shillings * F.lit(PENCE_PER_SHILLING).cast("bigint") + pence
    return F.when(raw.rlike(_PLAIN_AMOUNT), plain).otherwise(any_form)


def from_pence(c: Column | str) -> Column:
    """whole pence to text 'pounds shillings pence', rounding pounds down."""
    pence = _col(c).cast("bigint")
    rest = F.pmod(pence, F.lit(PENCE_PER_POUND).cast("bigint"))
    pounds = ((pence - rest) / PENCE_PER_POUND).cast("bigint")
    shillings = F.floor(rest / PENCE_PER_SHILLING)
    return F.when(
        pence.isNotNull(), F.concat_ws(" ", pounds, shillings, F.pmod(rest, F.lit(PENCE_PER_SHILLING)))
    )


def within_factor(a: Column, b: Column, factor: int = 2) -> Column:
    """One pair of the F8 agreement: neither amount exceeds ``factor`` times the other."""
    return (a <= b * factor) & (b <= a * factor)


def percentage(part: Column, whole: Column) -> Column:
    """per cent with two decimals, 0 for an empty whole."""
    return F.when(whole > 0, F.round(part * 100.0 / whole, 2)).otherwise(F.lit(0.0))


def fraction(threshold: float) -> float:
    """thresholds above 1 are per cent."""
    return threshold / 100.0 if threshold > 1 else float(threshold)


def basename(c: Column | str) -> Column:
    """last path part of a trimmed path."""
    return F.substring_index(trim_text(c), "/", -1)


def volume_of(c: Column | str) -> Column:
    """third underscore part, zero-padded to three, else '000'."""
    part = F.get(F.split(basename(c), "_"), F.lit(2))
    return F.when(part.isNull(), "000").when(F.length(part) < 3, F.lpad(part, 3, "0")).otherwise(part)


def image_path(c: Column | str, root: str) -> Column:
    """root/volume/name."""
    return F.concat_ws("/", F.lit(root), volume_of(c), basename(c))


def with_prefix(key: Column | str, prefix: str | None) -> Column:
    """put a cleaned folder prefix before an object key."""
    folder = (prefix or "").strip().strip("/")
    return F.concat(F.lit(folder + "/"), _col(key)) if folder else _col(key)


def result_name(c: Column | str) -> Column:
    """name of the result document of an image."""
    name = _col(c)
    return F.when(name.endswith(".jpg"), F.replace(name, F.lit(".jpg"), F.lit(".jpg.json"))).otherwise(
        F.concat(name, F.lit(".jpg.json"))
    )


def is_page_name(c: Column | str, pattern: str = PAGE_NAME_PATTERN) -> Column:
    """does a file name follow the page pattern?"""
    return _col(c).rlike(pattern)


def is_content_line(c: Column | str) -> Column:
    """P5: neither a blank line nor a comment."""
    return ~_col(c).rlike(COMMENT_OR_BLANK)
