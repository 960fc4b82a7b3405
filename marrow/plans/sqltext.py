"""DuckDB spellings of the text functions, for the oracle SQL.

Same patterns as :mod:`marrow.functions.text`; DuckDB needs the ``'g'`` flag
to replace every match.
"""

from __future__ import annotations

from marrow.functions import text as tx


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def rr(x: str, pattern: str, repl: str = "") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(repl)}, 'g')"


def strip_ws(x: str) -> str:
    return rr(rr(x, "^" + tx.WS + "+"), tx.WS + "+$")


def remove_urls(x: str) -> str:
    return rr(x, tx.URL_RE)


def remove_hashtags(x: str) -> str:
    return rr(x, tx.HASHTAG_RE)


def clean_whitespace(x: str) -> str:
    return strip_ws(rr(x, tx.WS + "+", " "))


def unmark_mentions(x: str) -> str:
    return rr(x, tx.MENTION_RE, r"\1")


def remove_emoji(x: str) -> str:
    return rr(x, tx.EMOJI_RE)


def join_underscores(x: str) -> str:
    return rr(x, tx.UNDERSCORE_RE, "_")


def clean_text(x: str) -> str:
    return f"lower({clean_whitespace(remove_hashtags(remove_urls(x)))})"


def ws_tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {q(tx.WS + '+')}), lambda t: t <> '')"


def split_of(doc_id: str) -> str:
    d = f"substr(md5(CAST({doc_id} AS VARCHAR)), 1, 1)"
    return (f"CASE WHEN {d} IN ('0','1') THEN 'test' WHEN {d} IN ('2','3') THEN 'dev' "
            f"ELSE 'train' END")


def url_path(x: str) -> str:
    return f"regexp_extract({x}, {q(r'^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(.*)$')}, 1)"
