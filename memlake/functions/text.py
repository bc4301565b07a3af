"""String functions as Column expressions. Null in, null out, unless a docstring says otherwise.

Lengths count Unicode code points. White space is the Unicode set, not ASCII only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memlake.functions.vectors import let

# The white space characters of ECMAScript, spelled for Java's regular expressions.
SPACE = r"[\s\x{b}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
INK = r"[^\s\x{b}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"

# Patterns of secrets and what replaces them, applied in this order.
SECRETS = (
    (r"(?i)Bearer\s+[A-Za-z0-9._\-+/=]{8,}", "Bearer [REDACTED]"),
    (r"(?i)(x-api-key|authorization)\s*[:=]\s*[A-Za-z0-9._\-+/=]{8,}", "$1: [REDACTED]"),
    (r"(?i)\b(api[_-]?key|token|secret)\b\s*[:=]\s*\"?[A-Za-z0-9._\-+/=]{8,}\"?", "$1=[REDACTED]"),
    (r"\bsk-(ant-)?[A-Za-z0-9_\-]{16,}", "sk-[REDACTED]"),
    (r"\bxox[baprs]-[A-Za-z0-9-]{10,}", "xox-[REDACTED]"),
    (r"\bghp_[A-Za-z0-9]{16,}", "ghp_[REDACTED]"),
    (r"\beyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+", "[JWT-REDACTED]"),
)

ATOMIC_ID = r"^[A-Z][A-Z0-9_]*--[A-Z0-9][A-Z0-9_-]*$"


def normalize_text(x: Column) -> Column:
    """Lower case; anything but letters, numbers and white space becomes a space; runs collapse; trimmed."""
    plain = F.regexp_replace(F.lower(x), rf"[^\p{{L}}\p{{N}}{SPACE[1:-1]}]", " ")
    return F.trim(F.regexp_replace(plain, SPACE + "+", " "))


def tokenize(x: Column) -> Column:
    """Normalised words of more than one character."""
    return F.filter(F.split(normalize_text(x), " "), lambda w: F.length(w) > 1)


def contains_snippet(haystack: Column, needle: Column, least: float = 0.6) -> Column:
    """Is the normalised needle in the haystack, or are their sets of words longer than two alike (Jaccard) by ``least``? False for an empty needle."""
    h, n = normalize_text(haystack), normalize_text(needle)
    words = lambda t: F.array_distinct(F.filter(F.split(t, " "), lambda w: F.length(w) > 2))
    hw, nw = words(h), words(n)
    alike = F.size(F.array_intersect(hw, nw)) / F.greatest(F.size(F.array_union(hw, nw)), F.lit(1)) >= least
    return F.when(n == "", F.lit(False)).otherwise(h.contains(n) | ((F.size(nw) > 0) & alike))


def collapse(x: Column) -> Column:
    """White space runs to one space, trimmed."""
    return F.trim(F.regexp_replace(x, SPACE + "+", " "))


def truncate(x: Column, limit: int, squeeze: bool = False) -> Column:
    """At most ``limit`` characters, the last an ellipsis where something was cut."""
    src = collapse(x) if squeeze else x
    return F.when(F.length(src) <= limit, src).otherwise(F.concat(F.substring(src, 1, limit - 1), F.lit("…")))


def redact_secrets(x: Column) -> Column:
    """Credential-shaped parts masked."""
    for pattern, instead in SECRETS:
        x = F.regexp_replace(x, pattern, instead)
    return x


def word_tokens(x: Column) -> Column:
    """Rough token estimate for chunk sizes: 1.3 for each run of ink, rounded up; 0 for null."""
    runs = F.coalesce(F.regexp_count(x, F.lit(INK + "+")), F.lit(0))
    return F.ceil(runs * F.lit(13) / F.lit(10)).cast("int")


def char_tokens(x: Column) -> Column:
    """Rough token estimate by length: a token for 3.5 characters, rounded up."""
    return F.ceil(F.length(x) / 3.5).cast("int")


def slugify(x: Column, limit: int | None = None, upper: bool = False) -> Column:
    """ASCII letters and digits joined by hyphens."""
    kept = F.regexp_replace(F.upper(x), "[^A-Z0-9]+", "-") if upper else F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-")
    kept = F.regexp_replace(kept, "^-+|-+$", "")
    return kept if limit is None else F.regexp_replace(F.substring(kept, 1, limit), "-+$", "")


def atomic_id(kind: str, term: Column) -> Column:
    """``KIND--TERM`` from free text."""
    return F.concat(F.lit(f"{kind}--"), slugify(term, upper=True))


def is_atomic_id(x: Column) -> Column:
    """Does the id have the form of an atom's? False for null."""
    return F.coalesce(x.rlike(ATOMIC_ID), F.lit(False))


def normalise_status(x: Column) -> Column:
    """Lower case and trimmed; ``approved`` and ``accepted`` are ``stable``."""
    plain = F.lower(F.trim(x))
    return F.when(plain.isin("approved", "accepted"), F.lit("stable")).otherwise(plain)


def derive_title(x: Column, words: int = 8) -> Column:
    """The first words of the first line; ``Untitled`` where it has none."""
    first = collapse(F.split(x, r"\r?\n")[0])
    title = F.array_join(F.slice(F.split(first, " "), 1, words), " ")
    return F.when(title == "", F.lit("Untitled")).otherwise(title)


def proposed_id(kind: Column, x: Column) -> Column:
    """``KIND--SLUG`` from a fact's text: the slug of its title, 40 characters at most; a null kind is ``FACT``."""
    slug = F.substring(slugify(derive_title(x), upper=True), 1, 40)
    return F.concat(F.upper(F.coalesce(kind, F.lit("fact"))), F.lit("--"), F.when(slug == "", F.lit("UNTITLED")).otherwise(slug))


def basename(path: Column) -> Column:
    """The last part of a path without ``.md``."""
    return F.regexp_replace(F.regexp_extract(path, r"(?s)([^/]*)\z", 1), r"(?i)\.md\z", "")


def extract_context(x: Column, needle: Column, length: int) -> Column:
    """About ``length`` characters around the first occurrence of ``needle``, ignoring case, white space collapsed; the start where there is none."""
    at = F.instr(F.lower(x), F.lower(needle))
    start = F.greatest(F.lit(0), at - 1 - length // 2)
    return F.when(at == 0, F.substring(x, 1, length)).otherwise(collapse(F.substring(x, start + 1, F.lit(length))))


def score_overlap(haystack: Column, needle: Column) -> Column:
    """The share of the needle's words (repeated ones count each time) that occur in the haystack; 0 without words."""
    own, wanted = tokenize(haystack), tokenize(needle)
    met = F.size(F.filter(wanted, lambda w: F.array_contains(own, w)))
    return F.when(F.size(wanted) <= 0, F.lit(0.0)).otherwise(met / F.size(wanted))


# Turn tags a transcript line may not start with, and what marks a collapsed line end.
TURN_TAGS = ("USER", "AGENT", "TOOL", "BRAIN", "MEMORY", "SYSTEM")
LINE_MARK = " ⏎ "


def one_line_turn(kind: Column, content: Column) -> Column:
    """A step as one labelled line; turn tags at the start of lines inside it are quoted, line ends marked."""
    safe = F.regexp_replace(content, "\r", "")
    safe = F.regexp_replace(safe, rf"(?i)\n{SPACE}*\[({'|'.join(TURN_TAGS)})\]", " [$1-quoted]")
    return F.concat(F.lit("["), F.upper(kind), F.lit("] "), F.regexp_replace(safe, r"\n+", LINE_MARK))


def wikilinks(x: Column) -> Column:
    """Distinct targets of ``[[target#heading|alias]]`` in order, without heading and alias."""
    raw = F.regexp_extract_all(x, F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(raw, lambda t: F.trim(F.regexp_replace(t, r"[#|].*$", ""))), lambda t: t != ""))


def first_sentence(x: Column) -> Column:
    """Up to the first full stop, question or exclamation mark followed by white space or the end."""
    found = F.regexp_extract(x, r"(?s)^\s*(.*?[.!?])(?:\s|$)", 1)
    return F.when(found == "", F.trim(x)).otherwise(found)


def symbol_parts(x: Column) -> Column:
    """``file[:fn[:line]]`` as a struct; empty parts and lines that are no positive number are null."""
    parts = F.split(x, ":")
    part = lambda i: F.nullif(F.try_element_at(parts, F.lit(i)), F.lit(""))
    line = part(3).try_cast("int")
    return F.struct(parts[0].alias("file"), part(2).alias("fn"), F.when(line > 0, line).alias("line"))


def stable_id(prefix: str, *parts: Column, digits: int = 16) -> Column:
    """A prefix and the start of the SHA-256 of the parts joined by ``::``."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(F.concat_ws("::", *parts), 256), 1, digits))


def front_matter(x: Column) -> Column:
    """The lines between the leading ``---`` markers, or null."""
    found = F.regexp_extract(x, r"(?s)\A---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)", 1)
    return F.nullif(found, F.lit(""))


def body(x: Column) -> Column:
    """The text behind the front matter."""
    return F.regexp_replace(x, r"(?s)\A---[ \t]*\r?\n.*?\r?\n---[ \t]*(?:\r?\n|\z)", "")


def front_fields(x: Column) -> Column:
    """Front matter of plain ``key: value`` lines as a map; the last of equal keys counts."""
    pairs = F.transform(
        F.filter(F.split(F.coalesce(front_matter(x), F.lit("")), r"\r?\n"), lambda line: line.rlike(r"^[A-Za-z_][\w-]*\s*:")),
        lambda line: F.struct(F.regexp_extract(line, r"^([A-Za-z_][\w-]*)\s*:", 1).alias("key"), F.trim(F.regexp_extract(line, r"^[A-Za-z_][\w-]*\s*:(.*)$", 1)).alias("value")),
    )
    last = lambda all_: F.filter(all_, lambda p, i: ~F.exists(F.slice(all_, i + 2, F.size(all_)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(let(pairs, last))


def half_up(x: Column, places: int = 2) -> Column:
    """Rounding of halves towards plus infinity, evaluated in binary."""
    scale = 10**places
    return F.floor(x * scale + 0.5) / scale


def clamp01(x: Column) -> Column:
    """Between 0 and 1; 0 for NaN and null."""
    return F.when(x.isNull() | F.isnan(x), F.lit(0.0)).otherwise(F.least(F.greatest(x.cast("double"), F.lit(0.0)), F.lit(1.0)))
