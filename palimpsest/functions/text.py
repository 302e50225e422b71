"""Text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TERM = "[a-z0-9]+"
#: What is cut from the end of a name, and the mark of a trimmed text.
NAME_ENDINGS, TRIM_MARK = ".,;:!?", "\n[truncated]"


def tokens(text: Column) -> Column:
    """Lower-case terms of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), "")


def token_estimate(text: Column) -> Column:
    """About 1.3 tokens a word."""
    return F.ceil(F.size(words(text)) * F.lit(1.3)).cast("long")


def canonical_name(name: Column) -> Column:
    """Lower case, single blanks, no closing punctuation."""
    return F.rtrim(F.regexp_replace(F.trim(F.lower(name)), r"\s+", " "), F.lit(NAME_ENDINGS))


def single_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def trimmed(text: Column, most: int) -> Column:
    """At most so many characters, with a mark where something was cut."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(max(0, most - 14))), F.lit(TRIM_MARK)))


def content_hash(*parts: Column, separator: str = "\x1f") -> Column:
    """A 128-bit name of a row from its parts, as hex."""
    return F.substring(F.sha2(F.concat_ws(separator, *parts).cast("binary"), 256), 1, 32)


def entity_id(name: Column, kind: Column) -> Column:
    return content_hash(canonical_name(name), kind, separator="::")


def fact_id(subject: Column, predicate: Column, obj: Column) -> Column:
    return content_hash(subject, predicate, obj)


def consolidator_fact_id(subject: Column, predicate: Column, obj: Column) -> Column:
    return content_hash(subject, predicate, obj, separator="::")


def community_id(members: Column) -> Column:
    return content_hash(F.array_join(F.sort_array(members), "::"))


def source_class(source: Column) -> Column:
    """What stands before the first colon."""
    return F.substring_index(source, ":", 1)


def entity_like(text: Column) -> Column:
    """Capitalised words but the first one."""
    w = words(text)
    return F.filter(F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda x: x.rlike("^[A-Z]"))


def is_hybrid_shape(text: Column) -> Column:
    """A question that names something is worth both ways of searching."""
    return F.size(entity_like(text)) > 0


def _starts_character(body: Column, place) -> Column:
    """Whether the byte at a place (from 1) begins a character, or lies behind the end."""
    return ~F.hex(F.substring(body, place, 1)).rlike("^[89AB]")


def byte_prefix(text: Column, most: int) -> Column:
    """The longest beginning of whole characters in at most so many bytes."""
    body, out = text.cast("binary"), F.when(F.octet_length(text) <= most, text)
    for back in range(min(4, most + 1)):
        out = out.when(_starts_character(body, most - back + 1), F.substring(body, 1, most - back).cast("string"))
    return out


def byte_suffix(text: Column, most: int) -> Column:
    """The longest end of whole characters in at most so many bytes."""
    body, n, out = text.cast("binary"), F.octet_length(text), F.when(F.octet_length(text) <= most, text)
    for skip in range(min(4, most + 1)):
        out = out.when(_starts_character(body, n - (most - skip - 1)), F.substring(body, n - (most - skip - 1), F.lit(most - skip)).cast("string"))
    return out


def truncated_payload(text: Column, above: int = 128 * 1024, head: int = 64 * 1024, tail: int = 32 * 1024) -> Column:
    """Payloads of more bytes keep their head and tail, each as many whole characters as its bytes allow."""
    return F.when(F.octet_length(text) <= above, text).otherwise(F.concat(byte_prefix(text, head), F.lit("…elided…"), byte_suffix(text, tail)))


#: What is redacted from captured text, in this order.
SECRETS = (
    ("ENV_KEY", r"[A-Z_][A-Z0-9_]{2,31}=[^\s\n]{4,}"),
    ("AWS_KEY", r"AKIA[0-9A-Z]{16}"),
    ("GH_TOKEN", r"gh[pousx]_[A-Za-z0-9_]{36}"),
    ("SSH_KEY", r"-----BEGIN [A-Z ]+ PRIVATE KEY-----"),
    ("JWT", r"eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+"),
    ("API_KEY", r"sk-(?:ant-)?[A-Za-z0-9_\-]{16,}"),
    ("SLACK_TOKEN", r"xox[baprs]-[A-Za-z0-9\-]{10,}"),
    ("GITLAB_PAT", r"glpat-[A-Za-z0-9_\-]{20}"),
    ("GCP_KEY", r"AIza[0-9A-Za-z_\-]{35}"),
    ("KV_SECRET", r"""(?i)\b(?:password|passwd|pwd|secret|token|api[_-]?key)["']?\s*[=:]\s*["']?[^\s"']{4,}"""),
    ("BEARER", r"(?i)\bbearer\s+[A-Za-z0-9\-._~+/]{16,}=*"),
)


def scrubbed(text: Column) -> Column:
    for name, pattern in SECRETS:
        text = F.regexp_replace(text, pattern, f"<REDACTED:{name}>")
    return text


def n_scrubbed(text: Column) -> Column:
    """Redactions, each rule counted on what the rules before it left."""
    n = F.lit(0)
    for name, pattern in SECRETS:
        n = n + F.regexp_count(text, F.lit(pattern))
        text = F.regexp_replace(text, pattern, f"<REDACTED:{name}>")
    return n.cast("long")
