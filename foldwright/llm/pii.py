"""Personal data: regular expressions propose spans, checksums confirm them,
nearby context words adjust the score.  DataFrame and SQL functions only.

Kinds in order: email, ip, card, phone (kept whenever their rule holds), then
iban (mod-97 confirmed), ssn and secret (kept when context lifts their score to
THRESHOLD).  Positions are code points, end exclusive; matches of one kind are
leftmost and do not overlap.

The patterns use possessive loops and run-start guards, which change no match
but keep Java's matcher free of recursion and of quadratic rescans on very long
runs.  Positions come from the lengths of the pieces between matches, so a text
is scanned by ``split`` and ``regexp_extract_all`` and nothing is exploded.  Running
sums go over groups of CHUNK pieces, then over the groups (of which CHUNK make one
more level), so that no array is rebuilt once a match.  Context is looked up in the
CONTEXT_CHARS characters before a match, as far back as the one before of its kind.

Defined cases: null text is empty; repeated rows stay repeated; a null id is
kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import table

THRESHOLD = 0.6
CONTEXT_CHARS = 40
CHUNK = 128
_LUHN = """(size(split(d, '')) between 12 and 19) and aggregate(transform(split(reverse(d), ''),
  (c, i) -> if(i % 2 = 0, cast(c as int), if(cast(c as int) > 4, 2 * cast(c as int) - 9, 2 * cast(c as int)))), 0, (a, v) -> a + v) % 10 = 0"""
_MOD97 = """aggregate(split(concat(substring(d, 5), substring(d, 1, 4)), ''), 0,
  (a, c) -> if(c >= 'A', (a * 100 + ascii(c) - 55) % 97, (a * 10 + cast(c as int)) % 97)) = 1"""


@dataclass(frozen=True)
class Kind:
    """valid tests ``m`` (the match) and ``d`` (its characters in keep); score
    is the score without context; gate tells from the text whether to look."""

    name: str
    pattern: str
    keep: str
    valid: str
    score: float
    gate: str
    context: str
    always: bool


KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "A-Za-z", "true", 0.9, "has_at", "mail|contact|write", True),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "0-9", r"regexp_like(m, '^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})([.]0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})){3}$')", 0.7, "has_digit", "ip|host|server|address|login", True),
    Kind("card", r"[0-9](?:[\x20-]?+[0-9])++", "0-9", _LUHN, 0.8, "has_digit", "card|visa|credit|pay|account", True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "0-9", "length(d) between 9 and 15", 0.7, "has_digit", "call|tel|phone|mobile|fax", True),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "A-Z0-9", f"length(d) between 15 and 34 and {_MOD97}", 0.8, "has_digit", "iban|bank|account|konto|transfer", False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "0-9", "substring(d, 1, 3) not in ('000', '666') and d < '900' and substring(d, 4, 2) <> '00' and substring(d, 6) <> '0000'", 0.4, "has_digit", "ssn|social security|tax", False),
    Kind("secret", r"(?<![A-Za-z0-9])[A-Fa-f0-9]{32,64}(?![A-Za-z0-9])", "A-Fa-f0-9", "true", 0.4, "has_digit", "token|secret|key|password|pwd", False),
)


_PIECE = "struct<g: bigint, n: bigint, m: string, c: boolean>"
_SPAN = "struct<s: bigint, e: bigint, m: string, c: boolean>"


def _groups(array: str, size: int) -> str:
    """SQL: the array cut into arrays of that size."""
    return f"transform(sequence(0, cast((size({array}) - 1) div {size} as int)), i -> slice({array}, i * {size} + 1, {size}))"


def _starts(lengths: str) -> str:
    """SQL: the running sums before each of an array of lengths."""
    return f"aggregate({lengths}, struct(0L as pos, cast(array() as array<bigint>) as out), (a, x) -> struct(a.pos + x as pos, concat(a.out, array(a.pos)) as out), a -> a.out)"


def _spans(pieces: str, start: str) -> str:
    """SQL: spans (s, e, m, c) of a group's pieces, from start on."""
    return f"""aggregate({pieces}, struct({start} as pos, cast(array() as array<{_SPAN}>) as out),
      (a, x) -> struct(a.pos + x.g + x.n as pos, concat(a.out, array(struct(a.pos + x.g as s, a.pos + x.g + x.n as e, x.m as m, x.c as c))) as out), a -> a.out)"""


def _length(pieces: str) -> str:
    return f"aggregate({pieces}, 0L, (t, y) -> t + y.g + y.n)"


def _pieces(k: Kind) -> str:
    """SQL: for each match the length of the text before it (from the last one), its
    own, itself, and whether a context word stands before it."""
    p = k.pattern.replace("\\", "\\\\")
    near = f"regexp_like(lower(right(g, {CONTEXT_CHARS})), '{k.context}')"
    return f"""if({k.gate}, zip_with(slice(split(text, '{p}', -1), 1, size(split(text, '{p}', -1)) - 1), regexp_extract_all(text, '{p}', 0),
      (g, m) -> struct(cast(length(g) as bigint) as g, cast(length(m) as bigint) as n, m as m, {near} as c)), cast(array() as array<{_PIECE}>))"""


def _positions(i: int) -> str:
    """SQL: array of (s, e, m, c) of the matches in column p<i>."""
    inner = f"flatten(zip_with(gg, {_starts(f'transform(gg, y -> {_length('y')})')}, (y, o) -> {_spans('y', 'b + o')}))"
    outer = f"transform(p{i}_groups, g -> {_groups('g', CHUNK)})"
    many = f"flatten(zip_with({outer}, {_starts(f'transform(p{i}_groups, y -> {_length('y')})')}, (gg, b) -> {inner}))"
    return f"if(size(p{i}) <= {CHUNK}, {_spans(f'p{i}', '0L')}, {many})"


def _confirmed(i: int, k: Kind) -> str:
    """SQL: array of (s, k, e, score) of the confirmed matches in column k<i>."""
    digits = f"regexp_replace(x.m, '[^{k.keep}]', '')"
    keep = re.sub(r"\bd\b", lambda _: digits, re.sub(r"\bm\b", "x.m", k.valid))
    score = f"{k.score}D + if(x.c, 0.3D, 0D)"
    out = f"transform(filter(k{i}, x -> {keep}), x -> struct(x.s as s, {i} as k, x.e as e, {score} as score))"
    return out if k.always else f"filter({out}, y -> y.score >= {THRESHOLD}D)"


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, spans): array of (s, k, e, score) by s, then kind index."""
    d = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.withColumns({"has_at": F.contains("text", F.lit("@")), "has_digit": F.col("text").rlike("[0-9]")})
    d = d.withColumns({f"p{i}": F.expr(_pieces(k)) for i, k in enumerate(KINDS)})
    many = f"if(size({{0}}) <= {CHUNK}, cast(array() as array<array<{_PIECE}>>), {_groups('{0}', CHUNK * CHUNK)})"
    d = d.withColumns({f"p{i}_groups": F.expr(many.format(f"p{i}")) for i in range(len(KINDS))})
    d = d.withColumns({f"k{i}": F.expr(_positions(i)) for i in range(len(KINDS))})
    return d.select("doc_id", F.expr("array_sort(concat(" + ", ".join(_confirmed(i, k) for i, k in enumerate(KINDS)) + "))").alias("spans"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    names = "array(" + ", ".join(f"'{k.name}'" for k in KINDS) + ")"
    joined = f"array_join(transform({{}}, x -> concat({names}[x.k], ':', x.s, ':', x.e)), ',')"
    count = lambda i: F.expr(f"cast(size(filter(spans, x -> x.k = {i})) as bigint)")
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{k.name}") for i, k in enumerate(KINDS[:4])],
        F.expr(f"sha2({joined.format('filter(spans, x -> x.k < 4)')}, 256)").alias("base_sha256"),
        F.expr(joined.format("spans")).alias("spans"),
    )
