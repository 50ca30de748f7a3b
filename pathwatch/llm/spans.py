"""Places of a pattern's matches in a text, with built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACES = "start:int,end:int,first:int,last:int"
SPAN = f"array<struct<{PLACES},match:string>>"
NEAR = f"array<struct<{PLACES},match:string,left:string,after:string>>"
#: Numbers that are added up one by one; longer arrays are cut into blocks, so that nothing is copied again and again.
BLOCK = 32


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often and in whatever lambda ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, plus: Callable[[Column, Column], Column], block: int = BLOCK) -> Column:
    """What ``plus`` (associative, 0 is neutral) makes of each int of an array and all before it.

    Within a block one by one, then over the blocks' totals: the array is copied once, not once for each element.
    """
    one = lambda x: F.array(x).cast("array<int>")

    def each(part: Column, start: Column, whole: bool) -> Column:
        """The running values of a short array; without the last, and with the start, if not ``whole``."""
        step = lambda acc, x: let(plus(acc["at"], x), lambda now: F.struct(now.alias("at"), F.concat(acc["out"], one(now if whole else acc["at"])).alias("out")))
        return F.aggregate(part, F.struct(start.alias("at"), F.array().cast("array<int>").alias("out")), step, lambda acc: acc["out"])

    def of(v: Column) -> Column:
        blocks = F.sequence(F.lit(0), ((F.size(v) - 1) / block).cast("int"))
        cut = lambda b: F.slice(v, b * block + 1, F.lit(block))
        totals = F.transform(blocks, lambda b: F.aggregate(cut(b), F.lit(0), lambda a, x: plus(a, x)))
        return let(each(totals, F.lit(0), False), lambda starts: F.flatten(F.transform(blocks, lambda b: each(cut(b), F.get(starts, b), True))))

    return let(values.cast("array<int>"), lambda v: F.when(F.size(v) > 0, of(v)).otherwise(F.array().cast("array<int>")))


def find_spans(text: Column, pattern: str, near: int = 0) -> Column:
    """array<struct<start,end,first,last,match>>: leftmost matches that don't overlap; end and last are exclusive.

    start and end count code points, first and last bytes of UTF-8. The text is split at the matches; a match starts
    where the gaps and matches before it end. With ``near``, spans also have ``left`` (up to so many characters before
    them, as far as the match before) and ``after`` (the character that follows, or nothing). The pattern never matches
    the empty string. Possessive quantifiers keep the work linear and the regex engine's stack flat.
    """
    kind = NEAR if near else SPAN
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))
    add = lambda a, x: a + x

    def of(s: Column) -> Column:
        m, g = s["m"], s["g"]
        ends = running(F.transform(m, lambda x, i: F.char_length(F.get(g, i)) + F.char_length(x)), add)
        lasts = running(F.transform(m, lambda x, i: F.octet_length(F.get(g, i)) + F.octet_length(x)), add)

        def span(x: Column, i: Column, at: Column) -> Column:
            end, last = F.get(at["e"], i), F.get(at["l"], i)
            parts = [(end - F.char_length(x)).alias("start"), end.alias("end"), (last - F.octet_length(x)).alias("first"), last.alias("last"), x.alias("match")]
            if near:
                before = F.concat(F.when(i > 0, F.get(m, i - 1)).otherwise(""), F.get(g, i))
                after = F.concat(F.substring(F.get(g, i + 1), 1, 1), F.coalesce(F.substring(F.get(m, i + 1), 1, 1), F.lit("")))
                parts += [F.right(before, F.lit(near)).alias("left"), F.substring(after, 1, 1).alias("after")]
            return F.struct(*parts)

        return let(F.struct(ends.alias("e"), lasts.alias("l")), lambda at: F.transform(m, lambda x, i: span(x, i, at))).cast(kind)

    return F.coalesce(let(both, lambda s: F.when(F.size(s["m"]) > 0, of(s))), F.array().cast(kind))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined, in the array's order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_sql(kinds: dict[str, tuple[str, str]], by_kind: bool) -> str:
    """DuckDB SQL for (doc_id, n_<kind> ..., base_sha256) of ``documents``, from the pattern of each kind and a condition on a match x.

    The digest's spans are ordered by kind, then start, or the other way round.
    """
    each = []
    for rank, (kind, (pattern, holds)) in enumerate(kinds.items()):
        quoted = "'" + pattern.replace("'", "''") + "'"
        each.append(f"""SELECT r, {rank} AS rank, '{kind}' AS kind, unnest(list_filter(list_transform(m, lambda x, i: {{'s': list_sum(list_transform(g[1:i], lambda y: len(y))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: len(y))), 0), 'x': x}}), lambda h: list_filter([h.x], lambda x: {holds}) <> [])) AS h
          FROM (SELECT r, regexp_extract_all(body, {quoted}) AS m, string_split_regex(body, {quoted}) AS g FROM d)""")
    order = "rank, h.s" if by_kind else "h.s, rank"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in kinds)
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS body FROM documents),
    f AS ({" UNION ALL ".join(each)})
    SELECT any_value(doc_id) AS doc_id, {counts}, sha256(coalesce(string_agg(kind || ':' || h.s::BIGINT || ':' || (h.s + len(h.x))::BIGINT, ',' ORDER BY {order}), '')) AS base_sha256 FROM d LEFT JOIN f USING (r) GROUP BY r"""
