"""Personal data: patterns propose spans, checks confirm them, nearby words move the score.

Per kind a pattern is matched twice over the whole text by built-in functions, once for
the matches and once for the text between them; lengths of both give code-point
positions. No shuffle, no Python. Nothing is matched across kinds, so a span may carry
two kinds.

email, ip, card and phone are reported whenever their own rule holds (octets up to 255,
13-19 digits with a valid Luhn sum, 9-15 digits). iban (mod-97) and ssn are added by
score: a base, plus what a valid checksum and a context word near the span give. Context is
read on both sides, across whatever else the text holds there; one word serves a whole list:
an iban or ssn no more than ``NEAR`` characters from one in context is in context as well.

An iban may be printed with single spaces. Where its country is known the pattern takes
exactly the characters that country has, so that it does not run into the next word; a
country that is not listed is taken unspaced or in groups of four. A letter right after an
ssn makes it something else.

Null text counts as empty and has no spans. Repeated ids are answered row by row; a table
without rows gives none. The patterns cannot backtrack over a run: a match never starts
inside a run that an earlier character of the same run would have started (``(?<!..)|\\G``),
and runs are possessive. Texts of any length are read whole, in time that grows with their
length and the number of their matches: what is carried from match to match goes through
runs of ``BLOCK`` of them, and no text is read from its beginning for each match.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import free_name, table

#: Characters on either side of a span in which a context word counts.
NEAR = 48
ACCEPT = 0.7
#: Elements of an array that are gathered one by one; blocks of so many are then strung together.
BLOCK = 128


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    gate: str  # condition on ``text`` without which there is no match
    valid: Callable[[str], str]  # check, given the SQL of the match
    base: float  # score of a match that passes its check
    context: str  # pattern of words that add 0.3
    least: int  # characters of the shortest match
    always: bool = True  # reported whatever its score


def _run(chars: str) -> str:
    return rf"(?:(?<![{chars}])|\G)[{chars}]++"


def _n_digits(m: str) -> str:
    return f"length(regexp_replace({m}, '[^0-9]', ''))"


def _luhn(m: str) -> str:
    """Every second digit from the right is doubled, and 9 taken off when it passes 9."""
    digit = "case when d = '' then 0 when i % 2 = 0 then int(d) when int(d) > 4 then 2 * int(d) - 9 else 2 * int(d) end"
    return f"aggregate(transform(split(reverse(regexp_replace({m}, '[^0-9]', '')), ''), (d, i) -> {digit}), 0, (a, d) -> a + d) % 10 = 0"


#: Characters of an iban by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}


def _iban() -> str:
    end = "(?![A-Za-z0-9])"
    known = "|".join(rf"(?:{cc.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}{end}" for n, cc in IBAN_LENGTHS.items())
    solid, grouped = "[A-Z0-9]{11,30}", r"(?:\x20(?![A-Z]{2}[0-9]{2})[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?"
    return rf"(?<![A-Za-z0-9])(?:{known}|[A-Z]{{2}}[0-9]{{2}}(?:{solid}|{grouped}){end})"


def _mod97(m: str) -> str:
    """First four characters last, letters as 10..35, remainder digit by digit; spaces do not count."""
    m = f"replace({m}, ' ', '')"
    step = "case when c = '' then a when c between '0' and '9' then (a * 10 + int(c)) % 97 else (a * 100 + ascii(c) - 55) % 97 end"
    return f"aggregate(split(concat(substring({m}, 5), substring({m}, 1, 4)), ''), 0, (a, c) -> {step}) = 1"


def _octets(m: str) -> str:
    return rf"forall(split({m}, '\\.'), p -> p rlike '^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{{1,2}})$')"


def _card(m: str) -> str:
    return f"case when {_n_digits(m)} between 13 and 19 then {_luhn(m)} else false end"


def _any(m: str) -> str:
    return "true"


KINDS = (
    Kind("email", _run("A-Za-z0-9._%+-") + r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "instr(text, '@') > 0", _any, 0.7, r"(?i)\b(e-?mail|mail|contact|write)\b", 5),
    Kind("ip", _run("0-9") + r"\.[0-9]++\.[0-9]++\.[0-9]++", "text rlike '[0-9][.][0-9]'", _octets, 0.6, r"(?i)\b(ip|host|server|address)\b", 7),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "text rlike '[0-9][ -]?[0-9]'", _card, 0.7, r"(?i)\b(card|credit|visa|pay)\b", 2),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "instr(text, '+') > 0", lambda m: f"{_n_digits(m)} between 9 and 15", 0.6, r"(?i)\b(phone|tel|call|mobile|fax)\b", 3),
    Kind("iban", _iban(), "text rlike '[A-Z]{2}[0-9]{2} ?[A-Z0-9]'", _mod97, 0.7, r"(?i)\b(iban|bank|account)\b", 15, False),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])", "text rlike '[0-9]{3}-[0-9]{2}-[0-9]{4}'", _any, 0.45, r"(?i)\b(ssn|social|security)\b", 11, False),
)
BASE_KINDS = ("email", "ip", "card", "phone")
_SPAN = "struct<kind:string,start:bigint,end:bigint,score:double>"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _parts(kind: Kind) -> str:
    """Matches with the text before each, and the text after the last: array of (m, gap)."""
    found = f"regexp_extract_all(text, {_quoted(kind.pattern)}, 0)"
    between = f"split(text, {_quoted(kind.pattern)}, -1)"
    return (
        f"case when {kind.gate} then zip_with({found}, {between}, (m, gap) -> named_struct('m', m, 'gap', gap)) "
        "else cast(array() as array<struct<m:string,gap:string>>) end"
    )


def _let(name: str, value: str, then: str) -> str:
    """``then`` with ``name`` for a value that is worked out once."""
    return f"transform(array({value}), {name} -> {then})[0]"


def _blocks(items: str) -> str:
    return f"transform(sequence(0, greatest(0, size({items}) - 1) div {BLOCK}), k -> slice({items}, k * {BLOCK} + 1, {BLOCK}))"


def _scan(items: str, start: str, step: str, value: str, kind: str) -> str:
    """Array of ``value`` for each item, where ``a`` is the state before it and ``step`` the state behind it.

    An array that grows by one copies what it holds, so only a block of items is gathered
    that way; the state at the head of each block is found first.
    """
    ends = (
        f"aggregate(blocks, named_struct('a', {start}, 'heads', array({start})), (c, block) -> "
        f"{_let('e', f'aggregate(block, c.a, (a, x) -> {step})', "named_struct('a', e, 'heads', concat(c.heads, array(e)))")}, c -> c.heads)"
    )
    inside = (
        f"aggregate(block, named_struct('a', heads[k], 'out', cast(array() as array<{kind}>)), "
        f"(c, x) -> transform(array(c.a), a -> named_struct('a', {step}, 'out', concat(c.out, array({value}))))[0], c -> c.out)"
    )
    return _let("blocks", _blocks(items), _let("heads", ends, f"flatten(transform(blocks, (block, k) -> {inside}))"))


def _positions(kind: Kind) -> str:
    """Matches with their positions and the text on both sides: array of (m, before, start, end, after)."""
    z, reach = f"_z_{kind.name}", NEAR // kind.least + 1
    starts = _scan(z, "0L", "a + length(x.gap) + coalesce(length(x.m), 0)", "a + length(x.gap)", "bigint")
    # the text beside a match is the gap there or, where that is short, what lies behind it: so many matches fill it
    left = f"array_join(transform(slice({z}, greatest(1, i + 1 - {reach}), least(i, {reach})), y -> concat(substring(y.gap, -{NEAR}), y.m)), '')"
    before = f"if(length(x.gap) >= {NEAR}, substring(x.gap, -{NEAR}), substring(concat({left}, x.gap), -{NEAR}))"
    right = f"array_join(transform(slice({z}, i + 2, {reach} + 1), y -> concat(substring(y.gap, 1, {NEAR}), coalesce(y.m, ''))), '')"
    after = f"substring({right}, 1, {NEAR})"
    row = f"named_struct('m', x.m, 'before', {before}, 'start', starts[i], 'end', starts[i] + length(x.m), 'after', {after})"
    return _let("starts", starts, f"filter(transform({z}, (x, i) -> {row}), x -> x.m is not null)")


def _in_list(spans: str) -> str:
    """``near`` passed on, both ways, to spans at most ``NEAR`` characters further."""
    row = "struct<start:bigint,end:bigint,near:boolean>"

    def swept(spans: str, gap: str, edge: str) -> str:
        near = f"(x.near or (a.near and {gap} <= {NEAR}))"
        return _scan(spans, "named_struct('at', 0L, 'near', false)", f"named_struct('at', x.{edge}, 'near', {near})", f"named_struct('start', x.start, 'end', x.end, 'near', {near})", row)

    forward = _let("forth", swept("spans", "x.start - a.at", "end"), _let("back", "reverse(forth)", swept("back", "a.at - x.end", "start")))
    return _let("spans", spans, f"reverse({forward})")


def _accepted(kind: Kind) -> str:
    near = f"x.before rlike {_quoted(kind.context)} or x.after rlike {_quoted(kind.context)}"
    spans = f"transform(filter(_c_{kind.name}, x -> {kind.valid('x.m')}), x -> named_struct('start', x.start, 'end', x.end, 'near', {near}))"
    score = f"round({kind.base} + if(x.near, 0.3, 0.0), 2)"
    scored = f"transform({spans if kind.always else _in_list(spans)}, x -> named_struct('kind', '{kind.name}', 'start', x.start, 'end', x.end, 'score', double({score})))"
    return scored if kind.always else f"filter({scored}, x -> x.score >= {ACCEPT})"


def find_spans(docs: DataFrame, text: str = "text", out: str = "spans", kinds=KINDS) -> DataFrame:
    """``docs`` plus ``out``: array of (kind, start, end, score), by kind as listed, then start."""
    boxed = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = boxed.select("row", *[F.expr(_parts(k)).alias(f"_z_{k.name}") for k in kinds])
    matched = parts.select("*", *[F.expr(_positions(k)).alias(f"_c_{k.name}") for k in kinds])
    checked = matched.select("row", F.concat(*[F.expr(_accepted(k)).cast(f"array<{_SPAN}>") for k in kinds]).alias("_spans"))
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c != out]
    return checked.select(*kept, F.col("_spans").alias(out))


def as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans merge into the first.

    Only ``text`` changes, and ``n_chars`` where the table has it. A null text stays null.
    """
    spans, by = free_name(docs, "_spans"), free_name(docs, "_sorted")
    found = find_spans(docs, out=spans)
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    rows = found.select(*[c for c in docs.columns if c != "text"], "text", by_start.alias(by))
    # what stands between the spans that are left when overlapping ones have merged, and the kind of each
    cuts = _scan(
        "spans", "0L", "if(x.start < a, greatest(a, x.end), x.end)",
        "named_struct('from', a, 'to', x.start, 'kind', x.kind, 'kept', x.start >= a, 'next', if(x.start < a, greatest(a, x.end), x.end))",
        "struct<from:bigint,to:bigint,kind:string,kept:boolean,next:bigint>",
    )
    piece = "concat(substring(part, int(x.from - block[0].from) + 1, int(x.to - x.from)), '[', upper(x.kind), ']')"
    cut_out = "substring(text, int(block[0].from) + 1, int(element_at(block, -1).to - block[0].from))"
    folded = F.expr(
        _let("spans", by, _let("cuts", f"filter({cuts}, x -> x.kept)", _let("last", f"array_max(transform({by}, x -> x.end))",
            f"concat(array_join(transform({_blocks('cuts')}, block -> {_let('part', cut_out, f"array_join(transform(block, x -> {piece}), '')")}), ''), substring(text, int(last) + 1))")))
    )
    clean = rows.withColumn("text", F.when(F.size(by) > 0, folded).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.size(by) > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return clean.select(*docs.columns)


def op2_pii(spark, sf_dir) -> DataFrame:
    found = find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id",
        *[F.expr(f"bigint(size(filter(spans, s -> s.kind = '{k}')))").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(as_text(base).cast("binary"), 256).alias("base_sha256"),
        as_text(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",").alias("scores"),
    )
