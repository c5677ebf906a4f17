"""Value rules that every operator shares: missing values, rounding, medians, dates, periods."""

from __future__ import annotations

import unicodedata
from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def truthy(c: Column, kind: str = "string") -> Column:
    """c, or null where it counts as missing: '' for strings, 0 for numbers, no elements for arrays."""
    if kind == "string":
        return F.nullif(c, F.lit(""))
    if kind == "array":
        return F.when(F.size(c) > 0, c)
    return F.nullif(c, F.lit(0))


def coalesce_truthy(*columns: Column, kind: str = "string", default: Column | None = None) -> Column:
    """The first column that is not missing."""
    return F.coalesce(*(truthy(c, kind) for c in columns), *([default] if default is not None else []))


def js_round(c: Column) -> Column:
    """Round half towards plus infinity."""
    return F.floor(c + 0.5)


def pct(part: Column, whole: Column) -> Column:
    """Whole percentage, 0 of nothing."""
    return F.when(whole != 0, js_round(part / whole * 100)).otherwise(0).cast("long")


def pct_label(part: Column, whole: Column) -> Column:
    """'0%' only for a count of zero; '<1%' for a count that rounds to zero."""
    n = pct(part, whole)
    return F.when((F.coalesce(whole, F.lit(0)) == 0) | (F.coalesce(part, F.lit(0)) == 0), "0%").when(n == 0, "<1%").otherwise(F.concat(n.cast("string"), F.lit("%")))


def ratio(part: Column, whole: Column, digits: int = 6) -> Column:
    """Rounded ratio, 0 over nothing."""
    return F.coalesce(F.round(F.try_divide(part.cast("double"), whole.cast("double")), digits), F.lit(0.0))


def upper_median(name: str) -> Column:
    """Aggregate over a column by name: the element at floor(n / 2) of the sorted values, null of none.

    Counted from the greatest value down, the discrete median of an even count is the upper
    of the two middle ones. The aggregate keeps one counter for each distinct value of a group.
    """
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{name}` DESC)")


def norm_ws(c: Column) -> Column:
    """Unicode white space collapsed and trimmed, lower case; null gives ''.

    Only runs and signs other than a plain space are replaced: single spaces, nearly all, stay untouched.
    """
    return F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)(?: \s|[\s&&[^ ]])\s*", " ")))


def kw_in(text: Column, keyword: str, ascii_words: bool = False) -> Column:
    """Whether a normalised text has a keyword; short single words match as whole words.

    ``ascii_words`` says that only ASCII letters, digits and the underscore make words.
    """
    k = " ".join(keyword.lower().split())
    if not k:
        return F.lit(False)
    if len(k) <= 3 and " " not in k:
        return text.rlike(rf"(?<![0-9A-Za-z_])\Q{k}\E(?![0-9A-Za-z_])" if ascii_words else rf"(?U)\b\Q{k}\E\b")
    return text.contains(k)


def any_kw(text: Column, keywords: list[str], ascii_words: bool = False) -> Column:
    """Whether a normalised text has any of the keywords.

    Long ones are one alternation, which the regular expression engine scans once.
    """
    plain = [k for k in keywords if len(k) > 3 or " " in k]
    short = [k for k in keywords if k not in plain]
    hits = [kw_in(text, k, ascii_words) for k in short]
    if plain:
        hits.append(text.rlike("|".join(rf"\Q{k}\E" for k in plain)))
    out = hits[0]
    for h in hits[1:]:
        out = out | h
    return out


def days_to(date: Column, as_of: datetime) -> Column:
    """Days from a fixed moment to midnight of an ISO date, rounded up; null for a blank date."""
    day = F.try_to_date(F.left(F.nullif(date, F.lit("")), F.lit(10)))
    micros = F.unix_micros(F.to_timestamp(day))
    return F.ceil((micros - F.lit(int(as_of.replace(tzinfo=UTC).timestamp() * 1_000_000))) / F.lit(86_400_000_000.0)).cast("long")


def third(date: Column) -> Column:
    """The third of the year (1 to 3) of a date, 0 if it has no month."""
    month = F.month(date)
    return F.coalesce(F.floor((month - 1) / 4) + 1, F.lit(0)).cast("int")


def period_key(date: Column) -> Column:
    """'YYYY-Cn', '' without a date."""
    return F.when(date.isNull(), "").otherwise(F.concat(F.year(date).cast("string"), F.lit("-C"), third(date).cast("string")))


def period_index(year: Column, n: Column) -> Column:
    """Consecutive numbers of periods, so that the period before is one less."""
    return (year * 3 + n - 1).cast("int")


def earliest(a: Column, b: Column) -> Column:
    """The earlier of two ISO dates as text; a blank one gives way to the other."""
    return F.coalesce(F.least(truthy(a), truthy(b)), F.lit(""))


def latest(a: Column, b: Column) -> Column:
    return F.coalesce(F.greatest(truthy(a), truthy(b)), F.lit(""))


def fold_accents(c: Column) -> Column:
    """Lower case without Latin accents, of the same length."""
    return F.translate(F.lower(c), "áàâäãåéèêëíìîïóòôöõúùûüñçý", "aaaaaaeeeeiiiiooooouuuuncy")


def fold_plain(c: Column) -> Column:
    """fold_accents, of a column that costs nothing: a text of ASCII alone is not looked at sign by sign."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(fold_accents(c))


def _bare(sign: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFD", sign) if not unicodedata.category(x).startswith("M"))


#: Letters that are another letter with marks, and those letters.
_MARKED = [(c, b) for c in map(chr, range(0xC0, 0x3000)) if len(b := _bare(c)) == 1 and b != c]


def strip_accents(c: Column) -> Column:
    """A text without the marks of its letters, in any script; marks of their own go too."""
    return F.regexp_replace(F.translate(c, "".join(a for a, _ in _MARKED), "".join(b for _, b in _MARKED)), r"\p{M}+", "")


def money_short(c: Column) -> Column:
    """'1.5M €' from a million, '12K €' from a thousand, else the number; '—' if missing."""
    millions = F.regexp_replace(F.format_number(F.floor(c / 100_000 + 0.5) / 10, 1), r"\.0$", "")
    millions = F.regexp_replace(millions, ",", "")
    whole = F.regexp_replace(F.format_number(F.floor(c + 0.5), 0), ",", ".")
    return (
        F.when(c.isNull(), "—")
        .when(c >= 1_000_000, F.concat(millions, F.lit("M €")))
        .when(c >= 1000, F.concat(js_round(c / 1000).cast("string"), F.lit("K €")))
        .otherwise(F.concat(whole, F.lit(" €")))
    )


def spanish_number(c: Column) -> Column:
    """A number written with dots for thousands and a comma for decimals; null if none."""
    s = F.regexp_replace(F.trim(c), r"\.(?=\d{3})", "")
    s = F.regexp_replace(F.replace(s, F.lit(","), F.lit(".")), r"[^\d.]", "")
    return s.try_cast("double")


def plain_number(c: Column) -> Column:
    """A number of an XML element: comma as decimal point, all other signs dropped."""
    return F.regexp_replace(F.replace(c, F.lit(","), F.lit(".")), r"[^\d.]", "").try_cast("double")


def budget_range(c: Column) -> Column:
    """An amount in the open range (100, 50 000 000), else null."""
    return F.when((c > 100) & (c < 50_000_000), c)


def tax_id_valid(c: Column) -> Column:
    """Whether a DNI or NIE has its right check letter; four leading zeros are rejected."""
    letters = "TRWAGMYFPDXBNJZSQVHLCKE"  # fixed value: check letters by remainder of 23
    s = F.upper(c)
    number = F.translate(F.substring(s, 1, 1), "XYZ", "012")
    number = F.concat(number, F.substring(s, 2, 7)).try_cast("int")
    shape = s.rlike(r"^([0-9]{8}|[XYZ][0-9]{7})[A-Z]$") & ~s.rlike("^[XYZ]?0000")
    return F.coalesce(shape & (F.substring(F.lit(letters), F.pmod(number, F.lit(23)) + 1, F.lit(1)) == F.right(s, F.lit(1))), F.lit(False))


def number_es(c: Column) -> Column:
    """A whole number with points between thousands, from five digits on; 0 if missing."""
    n = F.floor(F.coalesce(c, F.lit(0)) + 0.5)
    return F.when(F.abs(n) < 10000, n.cast("string")).otherwise(F.replace(F.format_number(n, 0), F.lit(","), F.lit(".")))


def money_full(c: Column) -> Column:
    """A whole amount in euros, '—' if missing; the space before the sign does not break."""
    return F.when(c.isNull(), "—").otherwise(F.concat(number_es(c), F.lit("\u00a0€")))


def day_first(c: Column) -> Column:
    """dd/mm/yyyy as yyyy-mm-dd, the digits as they are; null for any other text."""
    shape = r"^([0-9]{2})/([0-9]{2})/([0-9]{4})$"
    return F.when(F.trim(c).rlike(shape), F.regexp_replace(F.trim(c), shape, "$3-$2-$1"))


def iso_day(c: Column) -> Column:
    """The day that a text begins with as yyyy-mm-dd; null if it is no day of the calendar."""
    start = F.left(F.trim(c), F.lit(10))
    return F.when(start.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(start))
