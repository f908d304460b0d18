"""Name and title normalisers as Column expressions.

Every function takes and returns Columns, so Catalyst sees one expression and the
rows stay in generated code; nothing here calls Python for a row.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalith.functions import patterns as P
from catalith.functions import vocabulary as V

_ARTICLES = "|".join(a.lower() for a in V.ARTICLES)


def squeezed(x: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def stripped(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def let(x: Column, f) -> Column:
    """``f(x)`` with x computed once, however often f uses it."""
    return F.get(F.transform(F.array(x), lambda v: f(v)), F.lit(0))


def blank(x: Column) -> Column:
    """Null, or nothing but spaces."""
    return x.isNull() | (F.trim(x) == "")


def is_pending(x: Column) -> Column:
    """A progress stamp that isn't set: null or empty."""
    return x.isNull() | (x.cast("string") == "")


def any_word(x: Column, words, pattern: str = r"(?i)\b(?:{})\b") -> Column:
    return x.rlike(pattern.format("|".join(words)))


def is_in(x: Column, values) -> Column:
    return x.isin(*values)


# -- keys ---------------------------------------------------------------------


def without_accents(x: Column) -> Column:
    """Latin letters lose their accents, by a table over the Latin blocks."""
    pairs = [(chr(c), d) for c in range(0xC0, 0x250) if len(d := "".join(k for k in unicodedata.normalize("NFKD", chr(c)) if unicodedata.category(k) != "Mn")) == 1 and d != chr(c)]
    return F.translate(x, "".join(a for a, _ in pairs), "".join(b for _, b in pairs))


def fuzzy_key(x: Column) -> Column:
    """Lower case, no accents, one leading article gone, words only."""
    plain = F.lower(without_accents(F.coalesce(x, F.lit(""))))
    return squeezed(F.regexp_replace(F.regexp_replace(plain, r"^\s*(the|a|an)\s+", ""), r"[^\p{L}\p{N}_\s]", " "))


def canon_key(x: Column) -> Column:
    return squeezed(F.lower(x))


def without_qualifiers(title: Column) -> Column:
    """Version brackets, year and number brackets and bare version words become spaces."""
    return reduce(lambda x, p: F.regexp_replace(x, p, " "), P.QUALIFIERS, title)


def near_key(x: Column, title: bool = False) -> Column:
    """Key under which names and titles are compared; titles lose their qualifiers.

    A letter with a mark counts as the letter and a break, since a mark is no word
    character.
    """
    x = F.lower(without_qualifiers(x) if title else x)
    x = F.regexp_replace(x, f"([{''.join(_MARKED)}])", "$1 ")
    x = F.translate(x, "".join(_MARKED), "".join(_MARKED.values()))
    return F.regexp_replace(squeezed(F.regexp_replace(x, r"[^\p{L}\p{N}_\s]", " ")), r"^the ", "")


def _marked() -> dict[str, str]:
    letters = [chr(c) for c in range(0xDF, 0x250)]
    return {c: d[0] for c in letters if len(d := unicodedata.normalize("NFD", c)) > 1}


_MARKED = _marked()


def live(title: Column) -> Column:
    return title.rlike(P.LIVE_MARKER)


def pair_id(a: Column, b: Column) -> Column:
    return F.concat(F.lit("near_"), F.substring(F.sha2(F.concat(F.least(a, b), F.lit("\n"), F.greatest(a, b)), 256), 1, 8))


def group_id(prefix: str, digest: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(digest, 1, 12))


# -- articles and case --------------------------------------------------------

_SUFFIX = rf"(?i),?\s*\(\s*({_ARTICLES})\s*\)\s*$"
_COMMA = rf"(?i),\s*({_ARTICLES})\s*$"
_LEADING = rf"(?i)^({_ARTICLES}) (?=.)"


def capitalised(x: Column) -> Column:
    """First character upper, all others lower, whatever they are."""
    return F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1_000_000)))


def article_to_suffix(name: Column) -> Column:
    """``The X``, ``the X`` and ``X (the)`` become ``X, The``; protected names stay."""
    return let(stripped(name), _article_to_suffix)


def _article_to_suffix(s: Column) -> Column:
    def suffixed(base: Column) -> Column:
        bare = stripped(F.regexp_replace(base, r",+$", ""))
        return F.when(base.rlike(_COMMA), base).when(bare == "", s).otherwise(F.concat(bare, F.lit(", "), capitalised(F.regexp_extract(s, _SUFFIX, 1))))

    suffix = let(stripped(F.regexp_replace(s, _SUFFIX, "")), suffixed)
    rest = stripped(F.regexp_replace(s, _LEADING, ""))
    return (
        F.when(is_in(F.lower(s), V.PROTECTED_ARTISTS), s)
        .when(s.rlike(_COMMA), s)
        .when(s.rlike(_SUFFIX), suffix)
        .when(s.rlike(_LEADING), F.concat(rest, F.lit(", "), capitalised(F.regexp_extract(s, _LEADING, 1))))
        .otherwise(s)
    )


def natural_form(name: Column) -> Column:
    """The spoken form: ``Beatles, The`` and ``Beatles, The (the)`` become ``The Beatles``."""
    return let(stripped(name), _natural_form)


def _natural_form(s: Column) -> Column:
    def front(pattern: str, base: Column) -> Column:
        return F.when(base == "", s).otherwise(F.concat(capitalised(F.regexp_extract(s, pattern, 1)), F.lit(" "), base))

    outer = stripped(F.regexp_replace(stripped(F.regexp_replace(s, _SUFFIX, "")), r",+$", ""))
    outer = stripped(F.regexp_replace(outer, _COMMA, ""))
    return F.when(s.rlike(_SUFFIX), front(_SUFFIX, outer)).when(s.rlike(_COMMA), front(_COMMA, stripped(F.regexp_replace(s, _COMMA, "")))).otherwise(s)


def all_caps(x: Column) -> Column:
    """At least one letter, and every letter is upper case."""
    return x.rlike(r"\p{L}") & ~x.rlike(r"[\p{L}&&[^\p{Lu}]]")


_EDGE = r"\"'()\[\]{}.,!?;:-"


def special_spellings(x: Column) -> Column:
    """Rock 'n' Roll, R&B and feat. have one spelling, whatever joins their letters."""
    joined = r"\s*['`]?\s*"
    x = F.regexp_replace(x, joined.join((r"\b([Rr])ock", "[Nn]", r"[Rr]oll\b")), "$1ock 'n' Roll")
    x = F.regexp_replace(x, r"(?i)\br\s*[&'`]\s*b\b", "R&B")
    return F.regexp_replace(x, r"(?i)\bf(?:ea)?t\b\.?", "feat.")


def is_dotted(word: Column) -> Column:
    """Two letters or more, each followed by a dot, and nothing else."""
    return (F.length(word) >= 4) & (F.regexp_replace(word, r"[A-Za-z]\.", "") == "")


def title_case(x: Column) -> Column:
    """Title case that keeps acronyms, dotted abbreviations and Roman numerals."""
    return F.when(stripped(x) == "", x).otherwise(let(F.split(stripped(special_spellings(x)), r"\s+"), _cased_words))


def _cased_words(words: Column) -> Column:
    parts = F.transform(words, lambda w: F.struct(w.alias("word"), F.regexp_replace(w, rf"^[{_EDGE}]+|[{_EDGE}]+$", "").alias("clean")))

    def one(part: Column, i: Column) -> Column:
        word, clean = part["word"], part["clean"]
        upper = F.upper(clean)
        kept = F.when(clean == "", word).otherwise(F.replace(word, clean, upper))
        roman = (clean != "") & all_caps(clean) & ~is_in(upper, V.ROMAN_FALSE_FRIENDS) & upper.rlike(P.ROMAN_NUMERAL)
        return (
            F.when(is_dotted(word), F.upper(word))
            .when(is_in(upper, V.KEEP_CAPS) | roman, kept)
            .when((i == 0) | (i == F.size(words) - 1), capitalised(word))
            .when(is_in(F.lower(clean), V.LOWERCASE_WORDS), F.lower(word))
            .otherwise(capitalised(word))
        )

    return F.array_join(F.transform(parts, one), " ")


def changed(old: Column, new: Column) -> Column:
    """The new value, null where it is the old one."""
    return F.when(new != old, new)


def fixed_artist(artist: Column) -> Column:
    return changed(artist, article_to_suffix(F.when(all_caps(artist), title_case(artist)).otherwise(artist)))


def fixed_text(text: Column) -> Column:
    return changed(text, F.when(all_caps(text), title_case(text)).otherwise(text))


# -- file system --------------------------------------------------------------


def plain_typography(x: Column) -> Column:
    return F.translate(x, V.TYPOGRAPHIC, V.PLAIN)


def sanitised(x: Column) -> Column:
    """A value that file systems take; null if nothing is left.  Control characters go."""
    v = F.replace(F.translate(F.trim(x), "/\\", "--"), F.lit(":"), F.lit(" - "))
    v = plain_typography(F.regexp_replace(v, r'[?*"<>|]', ""))
    v = F.regexp_replace(squeezed(F.regexp_replace(v, r"[\x00-\x08\x0e-\x1f\x7f]", "")), r"[. ]+$", "")
    return F.when(v != "", v)


def needs_sanitising(x: Column) -> Column:
    return F.coalesce(x.rlike(P.UNSAFE_IN_VALUES) | x.rlike(f"[{V.TYPOGRAPHIC}]") | x.rlike(r"[. ]$"), F.lit(False))


def path_component(x: Column) -> Column:
    """One component of a path, safe on every file system; ``Unknown`` if nothing is left."""
    s = plain_typography(F.translate(F.coalesce(x, F.lit("")), "`", "'"))
    s = F.regexp_replace(F.regexp_replace(s, r"\p{C}", ""), P.FORBIDDEN_IN_NAMES, "_")
    s = F.regexp_replace(squeezed(s), r"^[. ]+|[. ]+$", "")
    return let(s, lambda v: F.when(v == "", "Unknown").when(is_in(F.upper(F.split_part(v, F.lit("."), F.lit(1))), V.RESERVED_NAMES), F.concat(F.lit("_"), v)).otherwise(v))


def folder_name(x: Column, limit: int = 120, default: str = "_unknown_") -> Column:
    s = F.regexp_replace(stripped(F.regexp_replace(x, P.FORBIDDEN_IN_NAMES, "_")), r"^\.+|\.+$", "")
    s = F.substring(s, 1, limit)
    return F.when(F.coalesce(s, F.lit("")) == "", default).otherwise(s)


def without_track_number(x: Column) -> Column:
    """The first prefix that goes and leaves something, else the text itself."""

    def shortest(s: Column) -> Column:
        tries = F.array(*[stripped(F.regexp_replace(s, p, "")) for p in P.TRACK_PREFIXES])
        return F.coalesce(F.get(F.filter(tries, lambda t: (t != "") & (t != s)), F.lit(0)), s)

    return let(stripped(x), shortest)


def track_filename(artist: Column, title: Column, ext: Column) -> Column:
    known = lambda x, d: F.when(F.coalesce(x, F.lit("")) == "", d).otherwise(x)
    dotted = F.when(ext.startswith("."), ext).otherwise(F.concat(F.lit("."), ext))
    return F.concat(path_component(known(artist, "Unknown Artist")), F.lit(" - "), path_component(without_track_number(known(title, "Unknown Title"))), F.lower(dotted))


def export_path(artist: Column, album: Column, track: Column, title: Column, path: Column, ext: Column) -> Column:
    known = lambda x, d: F.when(F.coalesce(x, F.lit("")) == "", d).otherwise(x)
    end = known(F.lower(ext), ".m4a")
    end = F.when(end.startswith("."), end).otherwise(F.concat(F.lit("."), end))
    name = folder_name(known(title, stem(path)))
    file = F.when(F.coalesce(track, F.lit(0)) != 0, F.concat(F.lpad(track.cast("string"), 2, "0"), F.lit(" - "), name, end)).otherwise(F.concat(name, end))
    return F.concat_ws("/", folder_name(primary_artist(artist)), folder_name(known(album, "Unknown Album")), file)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^./]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"(?<=.)(\.[^./]+)$", 1))


# -- credits ------------------------------------------------------------------

def _tail_is_article(x: Column) -> Column:
    return F.lower(stripped(F.regexp_extract(x, r"^[^,]*,(.*)$", 1))).isin("the", "a", "an")


def _before_comma(x: Column) -> Column:
    return F.when(x.contains(",") & ~_tail_is_article(x), stripped(F.split_part(x, F.lit(","), F.lit(1)))).otherwise(x)


def _unless_protected(x: Column, then: Column, names) -> Column:
    return F.when(is_in(F.lower(x), names), x).otherwise(then)


def without_guests(x: Column) -> Column:
    """Guest credits and comma tails go, ``and`` becomes ``&``; protected names stay."""
    steps = (
        lambda s: stripped(F.regexp_replace(s, P.GUEST_CREDIT, "")),
        lambda s: F.when(s.contains("&"), s).otherwise(_before_comma(s)),
        lambda s: F.regexp_replace(s, r"(?i)\band\b", "&"),
    )
    return _through(stripped(F.coalesce(x, F.lit(""))), steps, V.PROTECTED_FULL_NAMES)


def _through(x: Column, steps, names) -> Column:
    """Apply the steps in turn; a protected name stops them."""
    for step in steps:
        x = let(x, lambda v, step=step: _unless_protected(v, step(v), names))
    return x


def consolidation_key(x: Column) -> Column:
    """One key for all spellings of an artist; ASCII letters and digits only."""
    s = F.replace(F.replace(without_guests(x), F.lit("°"), F.lit("")), F.lit("&"), F.lit(" and "))
    for article in (P.LEADING_THE, P.TRAILING_THE, P.BRACKETED_THE):
        s = F.regexp_replace(s, article, "")
    return squeezed(F.regexp_replace(F.lower(s), r"[^a-z0-9\s]", " "))


def has_article(x: Column) -> Column:
    return x.rlike(P.LEADING_THE) | x.rlike(P.TRAILING_THE) | x.rlike(P.BRACKETED_THE)


def display_title(x: Column) -> Column:
    """Title case for display: short acronyms stay, connecting words are lower, ``, The`` stays."""
    tail = P.TRAILING_THE
    words = F.split(stripped(F.regexp_replace(x, tail, "")), r"\s+")

    def one(w: Column) -> Column:
        return F.when(F.lower(w).isin("and", "of", "the"), F.lower(w)).when(all_caps(w) & (F.length(w) <= 5), w).otherwise(capitalised(w))

    return F.concat(F.array_join(F.transform(words, one), " "), F.when(x.rlike(tail), ", The").otherwise(""))


def primary_artist(x: Column) -> Column:
    """The first credited artist, for folder names."""
    raw = stripped(F.when(F.coalesce(x, F.lit("")) == "", "Unknown Artist").otherwise(x))
    steps = [
        lambda s: stripped(F.regexp_replace(s, P.FEATURE_CREDIT, "")),
        lambda s: stripped(F.split_part(s, F.lit(";"), F.lit(1))),
        lambda s: stripped(F.split_part(s, F.lit(" & "), F.lit(1))),
        lambda s: F.coalesce(F.element_at(_dash_parts(s), 1), s),
        _before_comma,
    ]
    return let(_through(raw, steps, V.FOLDER_PROTECTED), lambda v: F.when(v == "", "Unknown Artist").otherwise(v))


def _dash_parts(s: Column) -> Column:
    parts = F.filter(F.transform(F.split(s, " - "), stripped), lambda p: p != "")
    return F.when(F.size(parts) >= 2, parts)


def is_various(x: Column) -> Column:
    a = F.lower(stripped(F.coalesce(x, F.lit(""))))
    return is_in(a, V.VARIOUS_FORMS) | a.rlike(r"^various artists?([^\p{L}\p{N}].*)?$")


def bracket_artist(path: Column) -> Column:
    """Artist in the first square bracket of the file name, before a label; empty if none."""
    content = F.regexp_extract(stem(path), r"\[([^\]]+)\]", 1)
    first = stripped(F.split_part(content, F.lit("-"), F.lit(1)))
    return F.when(content.contains("-") & (F.length(first) > 3), first).otherwise(stripped(content))


def segment_artist(path: Column) -> Column:
    """Second segment of ``Various Artists - Artist - Title``; empty if the name isn't so."""
    parts = F.transform(F.split(stem(path), " - "), stripped)
    return F.when((F.size(parts) >= 3) & is_various(F.get(parts, F.lit(0))), F.get(parts, F.lit(1))).otherwise("")


def real_artist(path: Column, looked_up: Column | None = None) -> Column:
    """struct(artist, strategy): brackets first, then segments, then a looked-up name."""
    ways = [("bracket", bracket_artist(path)), ("filename_segment", segment_artist(path))]
    ways += [("lookup", looked_up)] if looked_up is not None else []
    found = [F.when((F.coalesce(a, F.lit("")) != "") & ~is_various(a), F.struct(a.alias("artist"), F.lit(way).alias("strategy"))) for way, a in ways]
    return F.coalesce(*found, F.struct(F.lit("").alias("artist"), F.lit("unknown").alias("strategy")))


def junk_reason(artist: Column, title: Column, album: Column) -> Column:
    """Why a row is junk, null if it isn't; protected artists are never junk."""
    low = F.lower(stripped(F.coalesce(artist, F.lit(""))))
    holds = lambda names: reduce(lambda a, b: a | b, [low.contains(n) for n in names])
    words = "|".join(V.JUNK_ARTIST)
    return (
        F.when(holds(V.PROTECTED_FROM_JUNK), F.lit(None).cast("string"))
        .when(holds(V.KNOWN_JUNK_ARTISTS), "known_junk_artist")
        .when(low.rlike(rf"\b(?:{words})\b|\bre-?record"), "artist_pattern")
        .when(F.lower(F.coalesce(title, F.lit(""))).rlike("|".join(V.JUNK_TITLE)), "title_pattern")
        .when(F.lower(F.coalesce(album, F.lit(""))).rlike(rf"\b(?:{'|'.join(V.JUNK_ALBUM)})"), "album_pattern")
    )


# -- genres and playlists -----------------------------------------------------


def primary_genre(x: Column) -> Column:
    return stripped(F.split_part(x, F.lit(","), F.lit(1)))


def genre_file_name(x: Column) -> Column:
    g = stripped(x)
    named = reduce(lambda acc, kv: acc.when(g == kv[0], kv[1]), V.GENRE_FILE_NAMES.items(), F.when(F.lit(False), ""))
    return named.otherwise(F.translate(g, "/ ", "-_"))


def extinf(artist: Column, title: Column, path: Column) -> Column:
    """The information line of a playlist entry, from the names or else the file name."""
    s = stem(path)
    known = (F.coalesce(artist, F.lit("")) != "") & (F.coalesce(title, F.lit("")) != "")
    cut = F.instr(s, " - ")
    split = F.concat(stripped(F.substring(s, F.lit(1), cut - 1)), F.lit(" - "), stripped(F.substring(s, cut + 3, F.length(s))))
    return F.concat(F.lit("#EXTINF:-1,"), F.when(known, F.concat(stripped(artist), F.lit(" - "), stripped(title))).when(cut > 0, split).otherwise(s))


def human_size(n: Column) -> Column:
    """One decimal, halves to even."""
    tenth = lambda power: F.bround(n / 1024.0**power, 1)
    out = F.format_string("%.1f TB", tenth(4))
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        out = F.when(n < 1024.0 ** (power + 1), F.format_string(f"%.1f {unit}", tenth(power))).otherwise(out)
    return out


def human_duration(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    return F.when(s < 60, F.format_string("%ds", s)).when(s < 3600, F.format_string("%dm %02ds", F.floor(s / 60).cast("long"), s % 60)).otherwise(F.format_string("%dh %02dm", F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long")))


def starts_with(path: Column, prefix: str) -> Column:
    """The path lies below the prefix, whatever the case; nothing in the prefix is a wildcard."""
    return F.lower(path).startswith(prefix.lower())


def status_of_path(path: Column, root: str) -> Column:
    """Status that a file's place in the library tells: the first review folder decides."""
    places = {"DUPES_MOVED_FOR_REVIEW": "DUPE_REVIEW", "TRIBUTE_REMOVED_FOR_REVIEW": "TRIBUTE_REVIEW"}
    parts = F.split(F.substring(path, len(root) + 2, 100_000), "/")
    first = F.get(F.filter(parts, lambda p: p.isin(*places)), F.lit(0))
    found = reduce(lambda acc, kv: acc.when(first == kv[0], kv[1]), places.items(), F.when(~path.startswith(root + "/"), "CATALOGUED"))
    return found.otherwise("CATALOGUED")


def without_segment(path: Column, segment: str) -> Column:
    """The path without the first folder of that name."""
    return F.regexp_replace(path, rf"^(.*?)/{segment}/", "$1/")
