"""Text, time and identity expressions: Column in, Column out, all inside the JVM. Null in gives null out unless said otherwise."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"


@cache
def accent_table() -> tuple[str, str]:
    """Letters of the Latin blocks that are a base letter and marks, and their bases; n with tilde is left out."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        c = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if base != c and len(base) == 1 and c not in "ñÑ":
            pairs.append((c, base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def strip_accents(t: Column, keep_tilde_n: bool = True) -> Column:
    """Letters without accents; ñ and Ñ stay unless ``keep_tilde_n`` is false. A combining mark of its own goes, also after n."""
    a, b = accent_table()
    if not keep_tilde_n:
        a, b = a + "ñÑ", b + "nN"
    return F.regexp_replace(F.translate(t, a, b), r"\p{Mn}", "")


def squeeze(t: Column) -> Column:
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def normalize(t: Column) -> Column:
    """Accents off but ñ kept, white space squeezed."""
    return squeeze(strip_accents(t))


def clean(t: Column) -> Column:
    """Without bracketed notes on one line and named character references; at most one blank line in a row."""
    t = F.regexp_replace(F.regexp_replace(t, r"\[[^\n]*?\]", ""), "&[a-z]+;", "")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def terms(t: Column) -> Column:
    """Array of terms: words of lower-cased text without accents that are three or more letters a to z."""
    words = F.split(strip_accents(F.lower(t)), r"[^\p{L}\p{N}_]+")
    return F.filter(words, lambda w: w.rlike("^[a-z]{3,}$"))


def search_tokens(t: Column) -> Column:
    """Words split at white space, edge punctuation off, two characters or more, plural endings off."""
    words = F.transform(F.split(F.trim(F.regexp_replace(F.lower(t), r"\s+", " ")), " "), lambda w: F.regexp_replace(w, r"""^[.,;:!?¡¿()\[\]{}"']+|[.,;:!?¡¿()\[\]{}"']+$""", ""))
    long = F.filter(words, lambda w: F.length(w) >= 2)
    return F.transform(
        long,
        lambda w: F.when(w.endswith("es") & (F.length(w) > 4), F.substring(w, F.lit(1), F.length(w) - 2)).when(w.endswith("s") & (F.length(w) > 3), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w),
    )


def words(t: Column) -> Column:
    """Runs of word characters of lower-cased text."""
    return F.filter(F.split(F.lower(t), r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def alignment_tokens(t: Column) -> Column:
    """Lower case, all accents off (ñ too), runs of a to z and digits."""
    return F.filter(F.split(strip_accents(F.lower(t), False), "[^a-z0-9]+"), lambda w: w != "")


def flatten(t: Column) -> Column:
    """One line: line ends, also written out as a backslash and n, and runs of white space to one space."""
    return squeeze(F.replace(t, F.lit("\\n"), F.lit(" ")))


def snippet(t: Column, n: int = 70) -> Column:
    """At most ``n`` characters, cut at the last space if that lies beyond 70 % of them, with an ellipsis."""
    head = F.substring(t, 1, n)
    at = F.lit(n) - F.locate(" ", F.reverse(head))  # zero-based place of the last space
    cut = F.when(head.contains(" ") & (at > 0.7 * n), F.substring(head, F.lit(1), at)).otherwise(head)
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.rtrim(cut), F.lit("…")))


def highlight(t: Column, query: str) -> Column:
    """Words of the query with more than two characters marked as <<word>>, whatever their case."""
    wanted = [w for w in dict.fromkeys(query.lower().split()) if len(w) > 2]
    if not wanted:
        return t
    quoted = "|".join("".join(c if c.isalnum() else "\\" + c for c in w) for w in sorted(wanted, key=len, reverse=True))
    return F.regexp_replace(t, f"(?iu)({quoted})", "<<$1>>")


def is_segment(t: Column) -> Column:
    """Ten characters or more are left without punctuation."""
    return F.length(F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}_\s]", ""))) >= 10


def corrected(t: Column, fixes: list[tuple[str, str]]) -> Column:
    for wrong, right in fixes:
        t = F.replace(t, F.lit(wrong), F.lit(right))
    return t


def capped(t: Column, n: int) -> Column:
    """The first ``n`` words and three dots if there are more."""
    w = F.split(squeeze(t), " ")
    return F.when(F.size(w) > n, F.concat(F.array_join(F.slice(w, 1, n), " "), F.lit("..."))).otherwise(t)


def latex_text(t: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(t, r"\\[a-zA-Z]+", " "), r"[{}\[\]$^_&#%]", " ")
    return squeeze(t)


def without_error_pages(t: Column, marker: str = "Error 500") -> Column:
    return squeeze(F.replace(t, F.lit(marker), F.lit(" ")))


def clock(s: Column) -> Column:
    """Seconds as HH:MM:SS."""
    n = F.floor(s).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat_ws(":", two(F.floor(n / 3600)), two(F.floor(n % 3600 / 60)), two(n % 60))


def short_clock(s: Column) -> Column:
    """Seconds as MM:SS below an hour, HH:MM:SS from there; null and negative give a question mark."""
    return F.when(s.isNull() | (s < 0), "?").when(s < 3600, F.substring(clock(s), 4, 5)).otherwise(clock(s))


def seconds(t: Column) -> Column:
    """MM:SS or HH:MM:SS to seconds; any other format is null."""
    p = F.transform(F.split(F.trim(t), ":"), lambda x: x.try_cast("int"))
    ok = F.trim(t).rlike(r"^\d+(:[0-5]?\d){1,2}$")
    return F.when(ok & (F.size(p) == 2), p[0] * 60 + p[1]).when(ok & (F.size(p) == 3), p[0] * 3600 + p[1] * 60 + p[2])


def video_link(video: Column, s: Column, full: bool = False) -> Column:
    at = F.greatest(F.lit(0), F.floor(F.coalesce(s, F.lit(0))).cast("long"))
    if full:
        return F.concat(F.lit("https://www.youtube.com/watch?v="), video, F.lit("&t="), at, F.lit("s"))
    return F.concat(F.lit("https://youtu.be/"), video, F.lit("?t="), at)


def video_id(t: Column) -> Column:
    """The eleven characters of a video in a file name or address, else null."""
    hit = lambda p: F.nullif(F.regexp_extract(t, p, 1), F.lit(""))
    return F.coalesce(hit(r"Transcript_([A-Za-z0-9_-]{11})"), hit(r"(?:v=|youtu\.be/|/shorts/|/embed/|/live/)([A-Za-z0-9_-]{11})(?:[^A-Za-z0-9_-]|$)"), hit(r"^([A-Za-z0-9_-]{11})$"))


def content_id(url: Column) -> Column:
    """youtube:<id>, github:<user>/<repository>, else url: and 16 hex digits of the trimmed text's SHA-256."""
    u = F.trim(url)
    host = F.regexp_replace(F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", "")
    path = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    tube = host.isin("youtube.com", "m.youtube.com", "music.youtube.com")
    v = F.coalesce(
        F.nullif(F.when(tube & (path == "/watch"), F.regexp_extract(u, r"[?&]v=([^&#]+)", 1)), F.lit("")),
        F.nullif(F.when(tube, F.regexp_extract(path, r"^/(?:shorts|embed|live)/([^/]+)", 1)), F.lit("")),
        F.nullif(F.when(host == "youtu.be", F.regexp_extract(path, r"^/([^/]+)", 1)), F.lit("")),
    )
    repo = F.nullif(F.when(host == "github.com", F.regexp_extract(path, r"^/([^/]+/[^/]+)", 1)), F.lit(""))
    return F.coalesce(F.concat(F.lit("youtube:"), v), F.concat(F.lit("github:"), F.regexp_replace(repo, r"\.git$", "")), F.concat(F.lit("url:"), F.substring(F.sha2(u, 256), 1, 16)))


def source_type(t: Column) -> Column:
    low = F.lower(F.trim(t))
    return F.when(low.rlike(r"youtube\.com|youtu\.be"), "youtube").when(low.contains("github.com"), "github").when(low.rlike(r"\.pdf$"), "pdf").when(low.rlike(r"\.(txt|md)$"), "text").otherwise("unknown")


def text_hash(t: Column) -> Column:
    """16 hex digits of the SHA-256 of squeezed lower-case text; empty for empty."""
    n = F.lower(squeeze(t))
    return F.when(n == "", "").otherwise(F.substring(F.sha2(n, 256), 1, 16))


def change_hash(*fields: Column) -> Column:
    """SHA-256 of the fields as JSON in the order given; nulls are written."""
    return F.sha2(F.to_json(F.struct(*(f.alias(f"f{i}") for i, f in enumerate(fields))), {"ignoreNullFields": "false"}), 256)


def chunk_id(video: Column, place: Column, text: Column) -> Column:
    return F.concat(video, F.lit("_"), F.lpad(place.cast("string"), 4, "0"), F.lit("_"), F.substring(F.sha2(text, 256), 1, 8))


def entity_id(name: Column, kind: Column) -> Column:
    return F.concat(F.lit("ent:"), F.substring(F.md5(F.lower(F.concat_ws("_", name, kind))), 1, 12))


def evidence_level(types: Column) -> Column:
    """1 to 4 from an array of publication types, first rule that fits."""
    t = F.lower(F.array_join(types, " "))
    return F.when(t.rlike("meta-analysis|systematic review"), 1).when(t.contains("randomized controlled trial"), 2).when(t.rlike("clinical trial|cohort|observational"), 3).otherwise(4).cast("long")


def sentences(t: Column) -> Column:
    """Array of sentences: cut after . ! ? before white space, trimmed, none empty."""
    parts = F.split(t, r"(?<=[.!?])\s+")
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def occurrences(t: Column, needle: Column) -> Column:
    """How often ``needle`` occurs in ``t``, without overlaps; 0 for an empty needle."""
    return F.when(F.length(needle) > 0, ((F.length(t) - F.length(F.replace(t, needle, F.lit("")))) / F.length(needle))).otherwise(0).cast("long")


def whole_words(items: list[str]) -> str:
    """A pattern for any of ``items`` as whole words."""
    quoted = "|".join("".join(c if c.isalnum() else "\\" + c for c in w) for w in sorted(set(items), key=lambda w: (-len(w), w)))
    return rf"(?<![\p{{L}}\p{{N}}_])(?:{quoted})(?![\p{{L}}\p{{N}}_])"


def bind(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once, however often it is used, inside lambdas too."""
    return F.element_at(F.transform(F.array(value), then), 1)


def top_terms(tokens: Column, without: list[str], n: int) -> Column:
    """The ``n`` most frequent of an array of tokens, ties by first place, without the words of a short list. One sort of the row's tokens."""

    def counted(s: Column) -> Column:
        starts = F.filter(F.transform(s, lambda x, i: F.when(~F.coalesce(F.get(s, i - 1)["t"] == x["t"], F.lit(False)), i)), lambda i: i.isNotNull())
        return bind(starts, lambda at: F.transform(at, lambda p, k: F.struct((p - F.coalesce(F.get(at, k + 1), F.size(s))).alias("less"), F.get(s, p)["i"].alias("i"), F.get(s, p)["t"].alias("t"))))

    kept = F.filter(tokens, lambda t: ~t.isin(*without)) if without else tokens
    ordered = F.sort_array(F.transform(kept, lambda t, i: F.struct(t.alias("t"), i.alias("i"))))
    return F.transform(F.slice(F.sort_array(bind(ordered, counted)), 1, n), lambda x: x["t"])
