"""Text expressions: every function takes and returns a Column."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from marquee import fixed_values as V

SPACES = r"(?U)\s+"


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def text_or_empty(c) -> Column:
    return F.coalesce(_col(c), F.lit(""))


def blank_to_null(c) -> Column:
    """'' and NULL are both absent."""
    return F.nullif(_col(c), F.lit(""))


def squeeze(c) -> Column:
    return F.trim(F.regexp_replace(text_or_empty(c), SPACES, " "))


def norm_title(c) -> Column:
    """Lower case, no quotes, punctuation to spaces, single spaces."""
    bare = F.translate(F.lower(text_or_empty(c)), "\"'", "")
    return squeeze(F.regexp_replace(bare, r"(?U)[^\w\s]", " "))


def norm_venue(c) -> Column:
    """Lower case, listed suffixes stripped one after another."""
    name = F.lower(text_or_empty(c))
    for suffix in V.VENUE_SUFFIXES:
        name = F.regexp_replace(name, suffix + r"\z", "")
    return squeeze(name)


def norm_address(c) -> Column:
    """Parentheticals, text after a zip, number ranges and units removed."""
    s = F.trim(text_or_empty(c))
    steps = list(V.ADDRESS_CUTS)
    steps += [
        (rf"(?i)\b{word}\b(?=\s+(?:{V.STREET_TYPES})\b)", digits)
        for word, digits in V.ORDINAL_WORDS.items()
    ]
    steps += [(r"\s{2,}", " ")]
    for pattern, replacement in steps:
        s = F.regexp_replace(s, pattern, replacement)
    return F.trim(F.btrim(F.trim(s), F.lit(",")))


def city_hint(c) -> Column:
    """First listed city named in the address."""
    low = F.lower(text_or_empty(c))
    found = F.lit("Los Angeles, CA")
    for city in reversed(V.CITY_HINTS):
        found = F.when(low.contains(city.lower()), F.lit(f"{city}, CA")).otherwise(found)
    return found


def zips(c) -> Column:
    """All five-digit codes."""
    return F.regexp_extract_all(text_or_empty(c), F.lit(r"\b(\d{5})\b"), F.lit(1))


def any_term(text: Column, terms: list[str]) -> Column:
    """True when the text contains one of a fixed list of terms."""
    hit = F.lit(False)
    for term in terms:
        hit = hit | text.contains(term)
    return hit


def _trie_pattern(terms) -> str:
    """A pattern of the longest term at a place, shared beginnings once; many branches are told apart by class first."""
    root: dict = {}
    for term in terms:
        node = root
        for char in term:
            node = node.setdefault(char, {})
        node[""] = {}

    def choices(node: dict, chars: list[str]) -> str:
        if len(chars) <= 6:
            return "|".join(re.escape(c) + rest(node[c]) for c in chars)
        step = round(len(chars) ** 0.5)
        parts = [chars[i:i + step] for i in range(0, len(chars), step)]
        return "|".join(f"(?=[{''.join(map(re.escape, p))}])(?:{choices(node, p)})" for p in parts)

    def rest(node: dict) -> str:
        chars = sorted(c for c in node if c)
        if not chars:
            return ""
        return f"(?:{choices(node, chars)})" + ("?" if "" in node else "")

    return rest(root)


def terms_in(text: Column, terms) -> Column:
    """Array of the distinct terms that the text contains, overlapping ones too, in one walk over the text.

    At each place the longest term is read; the others there are its beginnings, known beforehand.
    Null text gives null, no terms an empty array. An empty term is in every text.
    """
    known = sorted(set(terms))
    if not known:
        return F.when(text.isNotNull(), F.array().cast("array<string>"))
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?=({_trie_pattern(known)}))"), F.lit(1)))
    heads = {t: [h for h in known if t.startswith(h)] for t in known}
    wider = {t: hs for t, hs in heads.items() if len(hs) > 1}
    if not wider:
        return found
    lookup = F.create_map(*[x for t, hs in wider.items() for x in (F.lit(t), F.array(*map(F.lit, hs)))])
    return F.array_distinct(F.flatten(F.transform(found, lambda t: F.coalesce(F.element_at(lookup, t), F.array(t)))))


def spaced(*parts) -> Column:
    """Lower-cased parts joined by one space, blank parts skipped."""
    return F.lower(F.concat_ws(" ", *[blank_to_null(p) for p in parts]))


def address_in_area(address, city, venue) -> Column:
    """City, neighbourhood or zip of the coverage area is named."""
    searched = spaced(address, city, venue)
    area_zips = F.array(*[F.lit(z) for z in V.AREA_ZIPS])
    return (
        F.coalesce(F.lower(_col(city)).isin(V.AREA_CITIES), F.lit(False))
        | any_term(searched, V.AREA_NEIGHBORHOODS)
        | F.arrays_overlap(zips(searched), area_zips)
    )


def compact_address(c) -> Column:
    """Trailing state and zip dropped."""
    tail = (
        r"(?i),\s*(California|CA)\s*,?\s*\d{5}(-\d{4})?\s*$"
        r"|,\s*(California|CA)\s*$|,\s*\d{5}(-\d{4})?\s*$"
    )
    bare = F.trim(F.regexp_replace(F.trim(text_or_empty(c)), tail, ""))
    return F.trim(F.rtrim(bare, F.lit(",")))


def clean_text(c) -> Column:
    """Source escapes of quotes undone, ends trimmed."""
    s = F.replace(text_or_empty(c), F.lit("\\'"), F.lit("'"))
    return F.trim(F.replace(s, F.lit('\\"'), F.lit('"')))


def strip_html(c) -> Column:
    """Tags to spaces, the four common entities decoded."""
    s = F.regexp_replace(text_or_empty(c), r"<[^>]+>", " ")
    for entity, char in [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]:
        s = F.replace(s, F.lit(entity), F.lit(char))
    return squeeze(s)


def strip_tags(c) -> Column:
    """Tags to spaces, entities left as they are."""
    return squeeze(F.regexp_replace(text_or_empty(c), r"<[^>]+>", " "))


def strip_markdown(c) -> Column:
    """Links, emphasis, divider lines and escapes flattened."""
    s = F.regexp_replace(text_or_empty(c), r"\[([^\]]+)\]\([^)]+\)", "$1")
    s = F.regexp_replace(s, r"(?U)(?<![\w*])(\*{1,3}|_{2})(\S(?:.*?\S)?)\1(?![\w*])", "$2")
    s = F.regexp_replace(s, r"(?m)^\s*[~#]+\s*$", "")
    s = F.regexp_replace(s, r"\\([*_\[\]()~#])", "$1")
    return squeeze(s)


def absolute_url(c, base) -> Column:
    """Relative links resolved against a base."""
    url, base = text_or_empty(c), text_or_empty(base)
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    return (
        F.when((url == "") | url.rlike("^https?://") | (base == ""), url)
        .when(url.startswith("/"), F.concat(origin, url))
        .otherwise(F.concat(F.rtrim(base, F.lit("/")), F.lit("/"), F.ltrim(url, F.lit("/"))))
    )


def ics_escape(c) -> Column:
    """X11: commas, semicolons and line ends escaped."""
    s = text_or_empty(c)
    for found, written in [("\n", "\\n"), ("\r", ""), (",", "\\,"), (";", "\\;")]:
        s = F.replace(s, F.lit(found), F.lit(written))
    return s


def ics_unescape(c) -> Column:
    """X11: the reverse, on one line."""
    s = text_or_empty(c)
    for found, written in [("\\n", " "), ("\\,", ","), ("\\;", ";"), ("\\\\", "\\")]:
        s = F.replace(s, F.lit(found), F.lit(written))
    return squeeze(s)


def slug(c) -> Column:
    """Lower case, runs of other characters to one hyphen."""
    dashed = F.regexp_replace(F.lower(text_or_empty(c)), r"[^a-z0-9]+", "-")
    return F.btrim(dashed, F.lit("-"))


def ics_filename(title, ts) -> Column:
    """File name of at most 50 characters plus the date."""
    kept = F.regexp_replace(text_or_empty(title), r"(?U)[^\w\s-]", "")
    dashed = F.lower(F.btrim(F.regexp_replace(kept, r"(?U)[-\s]+", "-"), F.lit("-")))
    day = F.date_format(_col(ts), "yyyy-MM-dd")
    return F.concat(F.substring(dashed, 1, 50), F.lit("-"), day, F.lit(".ics"))


def truncate_words(c, n: int) -> Column:
    """Cut at the last space before n characters, ellipsis added."""
    s = text_or_empty(c)
    cut = F.regexp_replace(F.substring(s, 1, n - 1), r" [^ ]*\z", "")
    return F.when(F.length(s) > n, F.concat(cut, F.lit("…"))).otherwise(s)


def truncate_hard(c, n: int) -> Column:
    """First n characters and three dots."""
    s = text_or_empty(c)
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n), F.lit("..."))).otherwise(s)


def occurrence_url(url, uid, start) -> Column:
    """Own URL, or the fallback page qualified by uid and start."""
    stamp = F.date_format(_col(start), "yyyyMMdd'T'HHmm")
    fragment = F.concat_ws("-", blank_to_null(uid), stamp)
    return F.concat(text_or_empty(url), F.lit("#"), fragment)


def dated_url(url, start, pattern: str = "yyyy-MM-dd") -> Column:
    """A non-empty URL gets the occurrence date as its fragment."""
    u = text_or_empty(url)
    stamped = F.concat(u, F.lit("#"), F.date_format(_col(start), pattern))
    return F.when(u == "", u).otherwise(stamped)


def split_title(c, locations: list[str]) -> Column:
    """struct(title, location) from "title | location"; unknown suffix kept."""
    raw = text_or_empty(c)
    tail = F.lower(F.trim(F.substring_index(raw, "|", -1)))
    head = F.trim(F.regexp_replace(raw, r"(?s)\|[^|]*\z", ""))
    known = raw.contains("|") & tail.isin(locations)
    return F.struct(
        F.when(known, head).otherwise(raw).alias("title"),
        F.when(known, tail).alias("location"),
    )


def at_venue(c) -> Column:
    """Text after the last @, or NULL."""
    raw = text_or_empty(c)
    return F.when(raw.contains("@"), F.trim(F.substring_index(raw, "@", -1)))


def mine_place(c) -> Column:
    """struct(venue, address) found in prose."""
    prose = text_or_empty(c)
    street = F.regexp_extract(prose, V.PROSE_ADDRESS_PATTERN, 1)
    low = F.lower(street)
    local = low.endswith(", ca") | low.contains("santa monica")
    address = (
        F.when(street == "", F.lit(""))
        .when(local, F.trim(street))
        .otherwise(F.concat(F.trim(street), F.lit(", Santa Monica, CA")))
    )
    named = F.regexp_extract_all(prose, F.lit(V.PROSE_VENUE_PATTERN), F.lit(1))
    stops = F.array(*[F.lit(p) for p in V.VENUE_STOP_PHRASES])
    fit = F.filter(
        F.transform(named, lambda v: F.trim(v)),
        lambda v: (F.length(v) >= 5)
        & ~F.exists(stops, lambda p: F.contains(F.lower(v), p))
        & ~v.rlike(rf"\b(?:{V.VENUE_STOP_VERBS})\b"),
    )
    return F.struct(F.coalesce(F.get(fit, F.lit(0)), F.lit("")).alias("venue"),
                    address.alias("address"))


def sanitize_query(c) -> Column:
    """Control characters to spaces, trimmed, quoted as one phrase."""
    bare = F.trim(F.regexp_replace(text_or_empty(c), r"[\x00-\x1f]", " "))
    doubled = F.replace(bare, F.lit('"'), F.lit('""'))
    return F.concat(F.lit('"'), doubled, F.lit('"'))


def date_label(start, end) -> Column:
    """One moment, or a range of days."""
    start, end = _col(start), _col(end)
    spans_days = F.to_date(end) > F.to_date(start)
    last = F.date_format(end, "MMM dd, yyyy")
    return (
        F.when(start.isNull(), F.lit("Date TBA"))
        .when(
            spans_days & (F.year(start) != F.year(end)),
            F.concat(F.date_format(start, "MMM dd, yyyy"), F.lit(" – "), last),
        )
        .when(spans_days, F.concat(F.date_format(start, "MMM dd"), F.lit(" – "), last))
        .otherwise(
            F.concat(
                F.date_format(start, "EEE, MMM dd, yyyy"),
                F.lit(" at "),
                F.date_format(start, "hh:mm a"),
            )
        )
    )


def time_label(start) -> Column:
    """Clock text, empty at midnight."""
    start = _col(start)
    untimed = start.isNull() | ((F.hour(start) == 0) & (F.minute(start) == 0))
    return F.when(untimed, F.lit("")).otherwise(F.date_format(start, "h:mm a"))


def join_address(*parts) -> Column:
    """Non-blank parts joined by commas."""
    return F.concat_ws(", ", *[blank_to_null(p) for p in parts])


def overlay(base, winner) -> Column:
    """Right side wins when it is not empty."""
    return F.coalesce(blank_to_null(winner), _col(base))


def split_list(c, separator: str = ",") -> Column:
    """Delimited text to an array, empty text to NULL."""
    return F.split(blank_to_null(c), separator)


def join_list(c, separator: str = ",") -> Column:
    """Array to delimited text, an empty array to NULL."""
    return blank_to_null(F.array_join(_col(c), separator))


def append_missing(text, names, template: str = "{text} — {names}") -> Column:
    """Names added to a text unless it already carries them."""
    text, joined = text_or_empty(text), F.array_join(F.filter(_col(names), lambda n: n != ""), ", ")
    present = (joined == "") | F.contains(F.lower(text), F.lower(joined))
    pieces = []
    for chunk in template.replace("{text}", "\0T\0").replace("{names}", "\0N\0").split("\0"):
        if chunk:
            pieces.append({"T": text, "N": joined}.get(chunk, F.lit(chunk)))
    return F.when(present, text).otherwise(F.trim(F.concat(*pieces)))


def _accent_table() -> tuple[str, str]:
    """Accented Latin letters and their base letters, from Unicode decomposition."""
    accented, plain = [], []
    for code in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and base[0].isalpha() and all(unicodedata.combining(x) for x in base[1:]):
            accented.append(chr(code))
            plain.append(base[0])
    return "".join(accented), "".join(plain)


_ACCENTED, _PLAIN = _accent_table()


def fold(c) -> Column:
    """Lower case without diacritics."""
    return F.lower(F.translate(text_or_empty(c), _ACCENTED, _PLAIN))


def words(c) -> Column:
    """Letter and digit runs of the folded text, in order."""
    return F.regexp_extract_all(fold(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
