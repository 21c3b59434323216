"""Text patterns and scalar column expressions (all JVM-side built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K

# Word characters: letters, marks, digits, underscore.
WORD = r"[\p{L}\p{M}\p{N}_]"


def _ranges(*lists) -> str:
    return "".join(f"{chr(a)}-{chr(b)}" for ranges in lists for a, b in ranges)


def _token_pattern(both, less) -> str:
    """Tokens by script, for an engine's class intersection ``both(class,
    ranges)`` and difference ``less(class, ranges)``. An ideograph or hiragana
    stands alone (with its marks); katakana and letters of scripts of the
    south-east make runs; other word characters make words, which may contain
    an apostrophe or dot between word characters ("don't", "1.5", "e.g")."""
    single, kata, run = (both(WORD, _ranges(r)) for r in (K.SINGLE_RANGES, K.KATAKANA_RANGES, K.RUN_RANGES))
    plain = less(WORD, _ranges(K.SINGLE_RANGES, K.KATAKANA_RANGES, K.RUN_RANGES))
    return rf"{plain}+(?:['’.]{plain}+)*|{single}\p{{M}}*|{kata}+|{run}+"


# ASCII comes first in the class: it is most of most texts
TOKEN_RE = _token_pattern(lambda c, r: f"[{c}&&[{r}]]", lambda c, r: f"[_0-9A-Za-z[{c}&&[^{r}]]]")
# the same tokens where a text is ASCII: none of the scripts' ranges is looked at
ASCII_TOKEN_RE = r"[_0-9A-Za-z]+(?:['.][_0-9A-Za-z]+)*"
# the same for query text, in the syntax of Python's regex module
QUERY_TOKEN_RE = "(?V1)" + _token_pattern(lambda c, r: f"[{c}&&[{r}]]", lambda c, r: f"[{c}--[{r}]]")
# Lossless split of a text into tokens and the gaps between them: the pieces
# concatenated give the text back, so a running sum of lengths gives offsets.
TOKEN_OR_GAP_RE = TOKEN_RE + r"|[^\p{L}\p{M}\p{N}_]+"
ASCII_TOKEN_OR_GAP_RE = ASCII_TOKEN_RE + r"|[^_0-9A-Za-z]+"
# A dot between word characters belongs to a token and ends no sentence; it is
# masked (same length) while a text is split.
TOKEN_DOT_RE = rf"\.(?={WORD})(?<={WORD}\.)"
DOT_MASK = "\ue000"
# Where a sentence ends, in text that is not masked.
SENTENCE_END = rf"(?:[!?\n]|\.(?!(?<={WORD}\.){WORD}))"
# Lossless split of masked text into sentences: a sentence runs to (and
# includes) its terminators; a trailing fragment without terminator is a
# sentence too.
SENTENCE_RE = r"[^.!?\n]*[.!?\n]+|[^.!?\n]+"
WHITESPACE_RUN = r"[ \t\n\x0B\f\r]+"
HTML_SCRIPT_RE = r"(?is)<script[^>]*>.*?</script>"
HTML_STYLE_RE = r"(?is)<style[^>]*>.*?</style>"
HTML_TAG_RE = r"<[^>]*>"
TOKEN_START_RE = "^" + WORD


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def tokens_of(text: Column) -> Column:
    """Lower-cased tokens of ``text`` in order (array<string>)."""
    low = F.lower(text)
    return F.when(is_ascii(text), F.regexp_extract_all(low, F.lit(ASCII_TOKEN_RE), 0)).otherwise(
        F.regexp_extract_all(low, F.lit(TOKEN_RE), 0))


def pieces_of(text: Column) -> Column:
    """Tokens and the gaps between them, in order (array<string>)."""
    return F.when(is_ascii(text), F.regexp_extract_all(text, F.lit(ASCII_TOKEN_OR_GAP_RE), 0)).otherwise(
        F.regexp_extract_all(text, F.lit(TOKEN_OR_GAP_RE), 0))


def is_term(token: Column) -> Column:
    """Whether a token is short enough to be a term."""
    return F.length(token) <= K.MAX_TOKEN_LENGTH


def extension_of(name: Column) -> Column:
    """Lower-cased text after the last dot; nothing when the dot is last."""
    return F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))


def is_unallocated(path: Column) -> Column:
    """Full path starts with the unallocated prefix."""
    return F.coalesce(path.startswith(K.UNALLOCATED_PREFIX), F.lit(False))


def type_priority(ext: Column) -> Column:
    """B15: 'high', 'medium' or 'low' for an extension (compared lower-cased)."""
    low = F.lower(ext)
    return (F.when(low.isin(*K.HIGH_PRIORITY_TYPES), F.lit("high"))
            .when(low.isin(*K.MED_PRIORITY_TYPES), F.lit("medium"))
            .otherwise(F.lit("low")))


def in_system_dir(path: Column) -> Column:
    """1 when the path contains any system directory marker."""
    hit = F.lit(False)
    for d in K.SYSTEM_DIRS:
        hit = hit | F.contains(path, F.lit(d))
    return F.when(hit, F.lit(1)).otherwise(F.lit(0))


def html_escape(text: Column) -> Column:
    """Escape the HTML special characters (&, <, >, ")."""
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    out = F.replace(out, F.lit("<"), F.lit("&lt;"))
    out = F.replace(out, F.lit(">"), F.lit("&gt;"))
    return F.replace(out, F.lit('"'), F.lit("&quot;"))


def strip_control(text: Column) -> Column:
    """B8 text part: drop every character below 0x20 (newline and tab too)."""
    return F.regexp_replace(text, r"[\x00-\x1f]", "")


def html_to_text(html: Column) -> Column:
    """B7 for HTML: drop script/style bodies and tags, collapse whitespace."""
    t = F.regexp_replace(html, HTML_SCRIPT_RE, " ")
    t = F.regexp_replace(t, HTML_STYLE_RE, " ")
    t = F.regexp_replace(t, HTML_TAG_RE, " ")
    return F.trim(F.regexp_replace(t, WHITESPACE_RUN, " "))
