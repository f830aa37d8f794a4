"""Scalar text functions as column expressions.

Python's notions of white space, letters and title case are spelled out as
explicit character classes, so that any SQL engine with linear regular
expressions gives the same values.  Nulls give null unless stated otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str methods see it.
SPACE = r"[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: A word: letters, digits, underscore, of any script.
WORD = r"[\p{L}\p{N}_]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often it is used
    (in lambdas an expression from outside is evaluated for every element)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clean(text: Column) -> Column:
    """Drop NUL characters, then join all white space to single spaces and strip."""
    return F.trim(F.regexp_replace(F.translate(text, "\0", ""), SPACE + "+", " "))


def clean_late(text: Column) -> Column:
    """As ``clean``, but NUL characters go after white space is joined."""
    return F.trim(F.translate(F.regexp_replace(text, SPACE + "+", " "), "\0", ""))


def fixed_chunks(text: Column, size: int = 512, overlap: int = 50) -> Column:
    """Windows of ``size`` characters every ``size - overlap``, while they start
    within the text; a text of at most ``size`` is one chunk, as is an empty one."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and under size")

    def cut(t: Column) -> Column:
        starts = F.sequence(F.lit(0), F.length(t) - 1, F.lit(size - overlap))
        return F.when(F.length(t) <= size, F.array(t)).otherwise(F.transform(starts, lambda s: F.substring(t, s + 1, F.lit(size))))

    return let(text, cut)


def word_chunks(text: Column, size: int = 300, least: int = 50, most: int = 10) -> Column:
    """Windows of ``size`` words; of those with more than ``least`` words the first ``most``."""

    def cut(words: Column) -> Column:
        starts = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
        windows = F.transform(starts, lambda s: F.slice(words, s + 1, F.lit(size)))
        return F.transform(F.slice(F.filter(windows, lambda w: F.size(w) > least), 1, most), lambda w: F.array_join(w, " "))

    return let(F.filter(F.split(text, SPACE + "+"), lambda w: w != ""), cut)


def section(text: Column, marker: str) -> Column:
    """What stands between the first and the second ``marker``, else the whole text."""
    return F.coalesce(F.get(F.split(text, _quoted(marker)), F.lit(1)), text)


def _quoted(plain: str) -> str:
    return "".join(f"\\{c}" if c in r"\.[]{}()*+?^$|" else c for c in plain)


def title(text: Column) -> Column:
    """Upper case for the first letter of every run of letters, lower case for the rest."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    # the one lower-case letter whose title case is two letters
    first = lambda r: F.when(F.substring(r, 1, 1) == "ß", "Ss").otherwise(F.upper(F.substring(r, 1, 1)))
    return F.array_join(F.transform(runs, lambda r: F.concat(first(r), F.substring(r, 2, 1 << 30))), "")


def entity_text(name: Column) -> Column:
    """White space joined, a leading article dropped, title case."""
    flat = F.trim(F.regexp_replace(name, SPACE + "+", " "))
    return title(F.trim(F.regexp_replace(flat, r"^(?i)(a|an|the) +", "")))


def entity(name: Column) -> Column:
    """Entity name as of ``entity_text``; null if shorter than two characters."""
    return let(entity_text(name), lambda done: F.when(F.length(done) > 1, done))


def relation(name: Column) -> Column:
    """Relation name: upper case, spaces as underscores; null if shorter than two characters."""
    done = F.upper(F.translate(F.trim(name), " ", "_"))
    return F.when(F.length(done) > 1, done)


def node_id(label: Column) -> Column:
    """Node key: lower case, spaces as underscores, only letters, digits and underscores."""
    return F.regexp_replace(F.translate(F.lower(label), " ", "_"), r"[^\p{L}\p{N}_]", "")


#: Relation names that are edge types of their own.
EDGE_TYPES = ("IS_A", "HAS_PROPERTY", "HAS_PART", "RELATED_TO", "CAUSES", "USED_FOR", "SIMILAR_TO", "BEFORE", "AFTER", "LEADS_TO")
#: Node types.
NODE_TYPES = ("CONCEPT", "ENTITY", "DOCUMENT", "PERSON", "TOPIC")


def edge_type(rel: Column) -> Column:
    return F.when(F.upper(rel).isin(*EDGE_TYPES), F.upper(rel)).otherwise("RELATED_TO")


def format_triple(s: Column, r: Column, o: Column) -> Column:
    return F.concat(F.lit("S:"), s, F.lit("|R:"), r, F.lit("|O:"), o)


def parse_triple(line: Column) -> Column:
    """Struct of subject, relation, object; null where the line has fewer than three parts."""
    parts = F.split(line, r"\|")
    at = lambda i, tag: F.trim(F.replace(F.get(parts, F.lit(i)), F.lit(tag), F.lit("")))
    return F.when(F.size(parts) >= 3, F.struct(at(0, "S:").alias("subject"), at(1, "R:").alias("relation"), at(2, "O:").alias("object")))


def parse_generated(text: Column, marker: str = "### Output:", confidence: float = 0.9) -> Column:
    """Triples from a model's answer: lines after ``marker`` that start with S:, malformed ones skipped."""
    body = F.when(F.instr(text, marker) > 0, F.get(F.split(text, _quoted(marker)), F.lit(1))).otherwise(text)
    lines = F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(x)), lambda x: x.startswith("S:"))
    parsed = F.filter(F.transform(lines, parse_triple), lambda t: t.isNotNull())
    return F.transform(parsed, lambda t: F.struct(t["subject"].alias("subject"), t["relation"].alias("relation"), t["object"].alias("object"), F.lit(confidence).alias("confidence")))


#: Where an 11-character video id stands.
VIDEO_PATTERNS = (
    r"youtube\.com/watch\?v=([a-zA-Z0-9_-]{11})",
    r"youtu\.be/([a-zA-Z0-9_-]{11})",
    r"youtube\.com/embed/([a-zA-Z0-9_-]{11})",
)


def video_id(text: Column) -> Column:
    """First pattern that matches wins; null if none does."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in VIDEO_PATTERNS])


def is_video_url(url: Column) -> Column:
    return F.coalesce(F.rlike(url, F.lit("|".join(VIDEO_PATTERNS))), F.lit(False))


def timestamp_label(seconds: Column) -> Column:
    """HH:MM:SS from an hour on, else MM:SS."""
    s = F.floor(seconds).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    h, m, r = F.floor(s / 3600).cast("long"), F.floor((s % 3600) / 60).cast("long"), s % 60
    hours = F.when(h < 10, two(h)).otherwise(h.cast("string"))
    return F.when(h > 0, F.concat_ws(":", hours, two(m), two(r))).otherwise(F.concat_ws(":", two(m), two(r)))


def duration_label(seconds: Column) -> Column:
    """m:ss."""
    s = seconds.cast("long")
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def upload_date(day: Column) -> Column:
    """YYYYMMDD as YYYY-MM-DD; anything else as it is."""
    parsed = F.when(F.rlike(day, F.lit(r"^\d{8}$")), F.date_format(F.try_to_timestamp(day, F.lit("yyyyMMdd")), "yyyy-MM-dd"))
    return F.coalesce(parsed, day)


def subtitle_text(events: Column) -> Column:
    """Text of subtitle events (array of structs with segs of utf8): a line for each that is not blank."""
    lines = F.transform(events, lambda e: F.trim(F.array_join(F.transform(e["segs"], lambda s: F.coalesce(s["utf8"], F.lit(""))), "")))
    return F.array_join(F.filter(lines, lambda x: F.coalesce(x, F.lit("")) != ""), "\n")


def transcript_lines(entries: Column) -> Column:
    """``[MM:SS] text`` lines from an array of structs (start, text)."""
    return F.array_join(F.transform(entries, lambda e: F.concat(F.lit("["), timestamp_label(e["start"]), F.lit("] "), e["text"])), "\n")


def front_matter(text: Column) -> Column:
    """Map fm_key -> value from the ``key: value`` lines between leading --- marks; empty without them."""
    block = F.get(F.split(text, "---", 3), F.lit(1))
    lines = F.filter(F.split(block, "\n"), lambda x: F.instr(x, ":") > 0)
    pairs = F.transform(lines, lambda x: F.struct(F.concat(F.lit("fm_"), F.trim(F.substring_index(x, ":", 1))).alias("key"), F.trim(F.substr(x, F.instr(x, ":") + 1)).alias("value")))
    # the last of equal keys wins
    unique = let(pairs, lambda ps: F.filter(ps, lambda p, i: ~F.exists(F.slice(ps, i + 2, F.size(ps)), lambda z: z["key"] == p["key"])))
    has = text.startswith("---") & (F.size(F.split(text, "---", 3)) >= 3)
    return F.when(has, F.map_from_entries(unique)).otherwise(F.create_map().cast("map<string,string>"))


def safe_filename(name: Column) -> Column:
    """Characters other than letters, digits, space, - and _ become _; first 100."""
    return F.substring(F.regexp_replace(name, r"[^\p{L}\p{N} _-]", "_"), 1, 100)


def concept_words(text: Column) -> Column:
    """Words longer than four characters that start in upper case, distinct and sorted."""
    words = F.split(F.trim(F.regexp_replace(text, SPACE + "+", " ")), " ")
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: (F.length(w) > 4) & F.rlike(w, F.lit(r"^\p{Lu}")))))


def stringify_metadata(meta: Column) -> Column:
    """Values of a string map as a vector store keeps them: null becomes "None"."""
    return F.transform_values(meta, lambda k, v: F.coalesce(v.cast("string"), F.lit("None")))


def sniff_metadata(meta: Column) -> Column:
    """Values read back: JSON where they parse as such, else the string itself, as VARIANT."""
    return F.transform_values(meta, lambda k, v: F.coalesce(F.try_parse_json(v), F.variant_get(F.parse_json(F.to_json(F.struct(v.alias("v")))), "$.v", "variant")))


def prompt(instruction: Column, text: Column) -> Column:
    """Instruction prompt for a model, open at the output."""
    return F.concat(F.lit("### Instruction:\n"), instruction, F.lit("\n\n### Input:\n"), text, F.lit("\n\n### Output:\n"))


def difficulty(i: Column, n: Column) -> Column:
    """Level of step ``i`` (from 0) of ``n``: thirds easy, medium, hard."""
    return F.when(i < n / 3, "easy").when(i < 2 * n / 3, "medium").otherwise("hard")


def time_needed(steps: Column) -> Column:
    """Half an hour a step."""
    hours = steps * 0.5
    return F.when(hours < 1, F.concat((hours * 60).cast("int").cast("string"), F.lit(" minutes"))).otherwise(F.concat(F.format_string("%.1f", hours), F.lit(" hours")))
