"""Functions of JSON payloads, instants and log positions that come as text."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def rounded(x: Column, places: int) -> Column:
    """A double rounded as SQL engines do it, by its product with a power of ten; Spark's own rounding goes by the decimal digits, and they part at halves."""
    y = F.round(x * F.lit(10.0**places)) / F.lit(10.0**places)
    return F.when(F.abs(y) == float("inf"), x).otherwise(y)


def repaired_json(text: Column) -> Column:
    """A variant of a JSON text, also of one whose quotes were made curly; null if it is neither."""
    plain = F.regexp_replace(F.regexp_replace(text, "[“”]", '"'), "[‘’]", "'")
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(plain))


def field(value: Column, *names: str) -> Column:
    """The first of a variant's fields that is a text with something in it."""
    found = [F.nullif(F.trim(F.try_variant_get(value, f"$.{n}", "string")), F.lit("")) for n in names]
    return F.coalesce(*found)


def payload_summary(source: Column, text: Column) -> Column:
    """One line for a decision or an edit that was written down as JSON; null for anything else."""
    from palimpsest.functions.text import trimmed

    def line(v: Column) -> Column:
        decision, why = field(v, "decision"), field(v, "rationale")
        path, body = field(v, "path", "file_path", "filePath"), field(v, "intent", "after", "new_string", "content")
        decided = F.when(decision.isNotNull(), F.concat(F.lit("decision: "), decision, F.coalesce(F.concat(F.lit("; rationale: "), trimmed(why, 120)), F.lit(""))))
        about = F.concat(F.lit("edit"), F.coalesce(F.concat(F.lit(" "), path), F.lit("")))
        edited = F.when(body.isNotNull(), F.concat(about, F.lit(": "), F.when(path.isNotNull(), trimmed(body, 180)).otherwise(trimmed(body, 200)))).when(path.isNotNull(), about)
        return F.when(source.startswith("decision:"), decided).when(source.startswith("edit:"), edited)

    return F.element_at(F.transform(F.array(repaired_json(text)), line), 1)


def _whole(x):
    """Numbers without a fraction as integers, within what 64 bits hold; all else as it is."""
    if isinstance(x, float) and x.is_integer() and -(2.0**63) <= x < 2.0**64:
        return int(x)
    if isinstance(x, list):
        return [_whole(y) for y in x]
    return {k: _whole(y) for k, y in x.items()} if isinstance(x, dict) else x


@F.pandas_udf(StringType())
def integral_numbers(texts: pd.Series) -> pd.Series:
    """JSON texts with 3.0 written as 3; what is no JSON becomes null."""

    def one(text):
        try:
            return None if text is None else json.dumps(_whole(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return None

    return texts.map(one)


@F.pandas_udf(StringType())
def first_object(texts: pd.Series) -> pd.Series:
    """The first stretch of a text from a brace to the one that closes it, braces within strings apart; null if there is none."""

    def one(text):
        depth = begin = 0
        inside = escaped = False
        for i, c in enumerate(text or ""):
            if inside:
                inside = escaped or c != '"'
                escaped = c == "\\" and not escaped
            elif c == '"' and depth:
                inside, escaped = True, False
            elif c == "{":
                begin, depth = (i, 1) if not depth else (begin, depth + 1)
            elif c == "}" and depth:
                depth -= 1
                if not depth:
                    return text[begin : i + 1]
        return None

    return texts.map(one)


def sorted_json(text: Column) -> Column:
    """A JSON object's canonical text: its keys in order, no blanks; null if it is no JSON."""
    return F.to_json(F.try_parse_json(text))  # a variant keeps its keys in order


def millis_of(instant: Column) -> Column:
    """Milliseconds of a text with date, time and zone; null for others and for times before 1970."""
    zoned = instant.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(\.\d+)?(Z|z|[+-]\d\d:\d\d)$")
    at = F.unix_millis(F.try_to_timestamp(F.when(zoned, F.upper(instant))))
    return F.when(at >= 0, at)


def instant_text(millis: Column) -> Column:
    """Milliseconds as a text with the zone +00:00, whatever the session's is."""
    from palimpsest.model import DAY

    day, ms = F.floor(millis / DAY), F.pmod(millis, F.lit(DAY))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    clock = [two(F.floor(ms / n) % m) for n, m in ((3_600_000, 24), (60_000, 60), (1000, 60))]
    part = F.when(ms % 1000 != 0, F.concat(F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"))).otherwise("")
    return F.concat(F.date_format(F.date_from_unix_date(day.cast("int")), "yyyy-MM-dd"), F.lit("T"), F.concat_ws(":", *clock), part, F.lit("+00:00"))


def instant_or(text: Column, fallback: Column) -> Column:
    """Milliseconds of an instant or, at midnight, of a date YYYY-MM-DD; the fallback for anything else."""
    from palimpsest.model import DAY

    plain = F.trim(text)
    date = F.try_to_date(F.when(plain.rlike(r"^\d{4}-\d\d-\d\d$"), plain), "yyyy-MM-dd")
    return F.coalesce(millis_of(plain), F.unix_date(date).cast("long") * DAY, fallback)


def log_position(text: Column) -> Column:
    """(wall_ms, counter, node) of two or three numbers with dots; null for anything else."""
    part = lambda i: F.element_at(F.split(text, r"\."), i)
    node = F.when(F.size(F.split(text, r"\.")) == 3, part(3)).otherwise("0")
    good = text.rlike(r"^\d{1,18}\.\d{1,10}(\.\d{1,5})?$")
    counter, n = part(2).cast("long"), node.cast("long")
    return F.when(good & (counter <= 4_294_967_295) & (n <= 65_535), F.struct(part(1).cast("long").alias("wall_ms"), counter.alias("counter"), n.alias("node")))
