"""Scalar text functions as Spark Column expressions (JVM-side, codegen'd).

All patterns use an explicit whitespace class so that Spark (Java regex),
DuckDB (RE2) and Python agree on what counts as whitespace.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the source semantics; stated together, as text).
# ---------------------------------------------------------------------------
# Whitespace as Python's str-regex ``\s`` sees it, written for Java and RE2.
WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"
# Its negation (Python's ``\S``).
NWS = r"[^\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"
# Hashtag: '#' followed by any run of non-whitespace (a lone '#' goes too).
HASHTAG_RE = "#" + NWS + "*"
# URLs, markdown image links and the literal '[photo]'.
URL_RE = r"https?://" + NWS + r"+|www\." + NWS + r"+|!\[img\]\([^)]+\)|\[photo\]"
# '@handle' -> 'handle'; a lone '@' stays.
MENTION_RE = "@(" + NWS + "+)"
# Reddit bot notice: opening phrase through the last '*' on the same line.
BOT_NOTICE_RE = r"\*I am a bot, and this action was performed automatically[^\n]*\*"
# Reddit emote image markup.
EMOTE_RE = r"!\[img\]\(emote\|[^|]+\|[^)]+\)"
# Emoji: the union of the source's 17 code-point ranges, reduced exactly.
EMOJI_RE = r"[\x{200d}\x{231a}\x{23cf}\x{23e9}\x{24c2}-\x{10ffff}]+"
# Spaces around an underscore joiner.
UNDERSCORE_RE = WS + "*_" + WS + "*"
# Reddit bodies that mean "no comment".
REMOVED_BODIES = ("[removed]", "[deleted]", "")
# Spellings that pandas.read_csv turns into NaN by default.
CSV_NA_VALUES = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
                 "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
                 "n/a", "nan", "null")
# Greedy JSON object inside a model reply (dot matches newlines).
JSON_OBJECT_RE = r"(?s)\{.*\}"
# Code fences around a JSON reply.
FENCE_RE = r"```json|```"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Python ``str.strip()``: trim the WS class on both ends."""
    return F.regexp_replace(F.regexp_replace(_c(c), "^" + WS + "+", ""), WS + "+$", "")


def remove_hashtags(c) -> Column:
    return F.regexp_replace(_c(c), HASHTAG_RE, "")


def remove_urls(c) -> Column:
    return F.regexp_replace(_c(c), URL_RE, "")


def to_lowercase(c) -> Column:
    return F.lower(_c(c))


def clean_whitespace(c) -> Column:
    """Collapse every whitespace run to one space, then strip.

    After the collapse the only whitespace left at either end is one plain
    space, so ``trim`` (which removes spaces) strips it without more regex.
    """
    return F.trim(F.regexp_replace(_c(c), WS + "+", " "))


def unmark_mentions(c) -> Column:
    return F.regexp_replace(_c(c), MENTION_RE, "$1")


def remove_emoji(c) -> Column:
    return F.regexp_replace(_c(c), EMOJI_RE, "")


def join_underscores(c) -> Column:
    return F.regexp_replace(_c(c), UNDERSCORE_RE, "_")


def strip_bot_notice(c) -> Column:
    return F.regexp_replace(_c(c), BOT_NOTICE_RE, "")


def strip_emotes(c) -> Column:
    return F.regexp_replace(_c(c), EMOTE_RE, "")


def ws_tokens(c) -> Column:
    """``text.split()``: whitespace tokens without empties."""
    return F.filter(F.split(_c(c), WS + "+"), lambda t: t != F.lit(""))


def space_tokens(c) -> Column:
    """``text.split(' ')``: single-space split that keeps empty pieces."""
    return F.split(_c(c), " ", -1)


def csv_null(c) -> Column:
    """Map the CSV NA spellings to null, as ``read_csv`` does."""
    col = _c(c)
    return F.when(col.isin(*CSV_NA_VALUES), F.lit(None).cast("string")).otherwise(col)


def id_prefix(c) -> Column:
    """Category part of ``<category>_<position>`` ids."""
    return F.split(_c(c), "_", 2).getItem(0)


def url_key(c) -> Column:
    """Video key of a watch or shorts link.

    A link with a path segment equal to ``shorts``: its last segment.  Any
    other link: the piece after the first '=' (kept as-is, so trailing
    ``&...`` parameters stay); null when there is no '='.
    """
    col = _c(c)
    return (F.when(F.array_contains(F.split(col, "/", -1), "shorts"),
                   F.element_at(F.split(col, "/", -1), -1))
             .otherwise(F.get(F.split(col, "=", -1), 1)))


def url_query_param(c, name: str) -> Column:
    """Robust form of :func:`url_key`: one query parameter (``parse_url``)."""
    return F.parse_url(_c(c), F.lit("QUERY"), F.lit(name))


def url_path(c) -> Column:
    """Everything after the host of an absolute URL (path, query, fragment)."""
    return F.regexp_extract(_c(c), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(.*)$", 1)


def extract_json_object(c, strip_fences: bool = False) -> Column:
    col = _c(c)
    if strip_fences:
        col = strip_ws(F.regexp_replace(col, FENCE_RE, ""))
    return F.nullif(F.regexp_extract(col, JSON_OBJECT_RE, 0), F.lit(""))


def has_letter(c) -> Column:
    return _c(c).rlike(r"\p{L}")
