"""Secret scan with multipart credential linking.

Base kinds are reported wherever they match.  Weak kinds (account names,
unlabelled keys, short assigned values, addresses of services) mean nothing
alone; they are parts of a credential.  The parts of a text are laid out by
position and joined as intervals: a weak part is reported only if the parts
that complete it lie in its scope, `reach` code points before or after it.

* an identifier needs a secret,
* a secret needs an identifier or an endpoint,
* an endpoint needs both.

A part is completed by another stretch of text only: parts that overlap do not
complete each other.  An unlabelled key inside the address of a service is a
piece of the address, not a part.

A scan needs no shuffle: positions come from splitting the text at its
matches, and the interval join only asks for the nearest part of each role
before and after, which running maxima over the sorted ends and starts answer
without pairs.

A null text is scanned as empty.  Null and repeated ids stay row by row, empty
tables give empty results, and other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import let, running, whole

REACH = 200
#: A text is cut into pieces of 2 ** PIECE_BITS code points to be redacted.
PIECE_BITS = 10
PLACEHOLDER = "[secret]"

_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_ACCOUNT = r"""(?i:access_key_id|access_key|client_id|username|user|account|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]+)"""
_SERVICE = r"""(?:https?|ftp|jdbc|postgres|postgresql|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D"'<>]+"""


@dataclass(frozen=True)
class Kind:
    """What a match is called, which part of a credential it is, and which matches stay.

    `shortest` and `longest` bound the length of the given group; the whole
    match is the span.  `mixed` asks for digits and both cases in it.
    """

    name: str
    role: str
    pattern: str
    group: int = 0
    shortest: int = 1
    longest: int = 1 << 30
    weak: bool = False
    mixed: bool = False
    needs: tuple[str, ...] = ()

    def in_text(self, text: Column) -> Column:
        """Has the text a match?  Plain strings that any match holds are looked for first."""
        found = text.rlike(self.pattern)
        return reduce(Column.__or__, [text.contains(n) for n in self.needs]) & found if self.needs else found


#: In the order in which spans that start together are listed.
#: Runs have no way to match later within themselves, so a least length may
#: stand in the pattern for them; assignments are matched first, then dropped.
KINDS = (
    Kind("assign", "secret", _ASSIGN, 1, 8, needs=("=", ":")),
    Kind("access", "identifier", r"AKIA[A-Z0-9]{12,}", needs=("AKIA",)),
    Kind("hex", "secret", r"(?<![0-9a-f])[0-9a-f]{32,}"),
    Kind("link_id", "identifier", _ACCOUNT, 1, 3, weak=True, needs=("=", ":")),
    Kind("link_secret", "secret", r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{20,}", weak=True, mixed=True),
    Kind("link_short", "secret", _ASSIGN, 1, 4, 7, weak=True, needs=("=", ":")),
    Kind("link_host", "endpoint", _SERVICE, weak=True, needs=("://",)),
)
BASE = tuple(k.name for k in KINDS if not k.weak)
ROLES = ("identifier", "secret", "endpoint")
_SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


def _matches(text: Column, place: int, kind: Kind) -> Column:
    """Spans of one kind: the lengths between and of the matches, summed up."""
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.group))
    between = F.transform(F.split(text, kind.pattern, -1), lambda gap: F.length(gap).cast("bigint"))
    lengths = F.transform(found, lambda match: F.length(match).cast("bigint"))

    def good(v: Column) -> Column:
        fits = F.length(v).between(kind.shortest, kind.longest)
        return fits & v.rlike("[0-9]") & v.rlike("[A-Z]") & v.rlike("[a-z]") if kind.mixed else fits

    def spans(length: Column) -> Column:
        def placed(gaps: Column) -> Column:
            steps = F.transform(length, lambda _, i: F.get(gaps, i) + F.coalesce(F.get(length, i - 1), F.lit(0)))
            return let(running(steps, lambda a, b: a + b), with_ends)

        def with_ends(starts: Column) -> Column:
            return F.zip_with(
                starts,
                length,
                lambda start, n: F.struct(start.alias("start"), F.lit(place).alias("kind"), (start + n).alias("end")),
            )

        return let(between, placed)

    checked = F.zip_with(
        let(lengths, spans), value, lambda span, v: F.struct(span.alias("span"), good(v).alias("good"))
    )
    stay = F.transform(F.filter(checked, lambda s: s["good"]), lambda s: s["span"])
    return F.when(kind.in_text(text), stay).otherwise(F.array()).cast(_SPAN)


def _linked(parts: Column, reach: int) -> Column:
    """Base spans, and the weak ones that their scope completes."""
    far = 1 << 60
    kinds = lambda test: [i for i, k in enumerate(KINDS) if test(k)]

    def nearest(chosen: list[int]) -> tuple[Column, Column]:
        """Ends so far from the left and starts so far from the right, for the given kinds."""
        ends = F.transform(parts, lambda p: F.when(p["kind"].isin(chosen), p["end"]).otherwise(F.lit(-far)))
        starts = F.transform(parts, lambda p: F.when(p["kind"].isin(chosen), p["start"]).otherwise(F.lit(far)))
        return running(ends, F.greatest), F.reverse(running(F.reverse(starts), F.least))

    def beside(chosen: list[int]) -> tuple[Column, Column]:
        """Of every part the last end up to its start, and the first start from its end on, for the given kinds."""

        def events(own: str, other: str, first: int) -> Column:
            asks = F.transform(
                parts, lambda p, i: F.struct(p[own].alias("at"), F.lit(1 - first).alias("turn"), i.alias("part"), F.lit(None).cast("bigint").alias("place"))
            )
            tells = F.transform(
                F.filter(parts, lambda p: p["kind"].isin(chosen)),
                lambda p: F.struct(p[other].alias("at"), F.lit(first).alias("turn"), F.lit(-1).alias("part"), p[other].alias("place")),
            )
            return F.array_sort(F.concat(asks, tells))

        def answers(sorted_: Column, places: Column) -> Column:
            told = F.zip_with(sorted_, places, lambda e, place: F.struct(e["part"].alias("part"), place.alias("place")))
            return F.transform(F.array_sort(F.filter(told, lambda t: t["part"] >= 0)), lambda t: t["place"])

        def before(sorted_: Column) -> Column:
            return answers(sorted_, running(F.transform(sorted_, lambda e: F.coalesce(e["place"], F.lit(-far))), F.greatest))

        def after(sorted_: Column) -> Column:
            starts = F.transform(sorted_, lambda e: F.coalesce(e["place"], F.lit(far)))
            return answers(sorted_, F.reverse(running(F.reverse(starts), F.least)))

        # At one position ends are told before they are asked for, and starts after.
        return let(events("start", "end", 0), before), let(events("end", "start", 1), after)

    groups = {role: kinds(lambda k, role=role: k.role == role) for role in ROLES}
    base = kinds(lambda k: not k.weak)
    columns = [c for group in groups.values() for c in beside(group)] + list(nearest(base))

    def judge(near: Column) -> Column:
        at = {name: (2 * i, 2 * i + 1) for i, name in enumerate([*groups, "base"])}

        def stays(part: Column, i: Column) -> Column:
            def within(name: str, gap: int) -> Column:
                left, right = at[name]
                return (F.get(near[left], i) > part["start"] - gap) | (F.get(near[right], i) < part["end"] + gap)

            role = lambda name: part["kind"].isin(groups[name])
            complete = (
                F.when(role("identifier"), within("secret", reach))
                .when(role("secret"), within("identifier", reach) | within("endpoint", reach))
                .otherwise(within("identifier", reach) & within("secret", reach))
            )
            weak = ~part["kind"].isin(base)
            return F.struct(part.alias("part"), (~weak | (~within("base", 0) & complete)).alias("stays"))

        return F.transform(
            F.filter(F.transform(parts, stays), lambda p: p["stays"]),
            lambda p: p["part"],
        )

    return let(F.array(*columns), judge)


def _outside(parts: Column) -> Column:
    """The sorted parts without unlabelled keys that lie inside the address of a service."""
    key, host = ([k.name for k in KINDS].index(name) for name in ("link_secret", "link_host"))
    ends = F.transform(parts, lambda p: F.when(p["kind"] == host, p["end"]).otherwise(F.lit(-1)).cast("bigint"))

    def cleared(upto: Column) -> Column:
        return F.filter(parts, lambda p, i: (p["kind"] != key) | (F.get(upto, i) < p["end"]))

    return F.when(F.exists(parts, lambda p: p["kind"] == host), let(running(ends, F.greatest), cleared)).otherwise(parts)


def spans(text: Column, reach: int = REACH) -> list[tuple[str, Column]]:
    """The columns to add one after another for `spans_of`; see `scan`."""
    found = F.concat(*[_matches(text, place, kind) for place, kind in enumerate(KINDS)])
    weak = [i for i, k in enumerate(KINDS) if k.weak]
    return [
        ("__found", F.array_sort(found)),
        ("__parts", _outside(F.col("__found"))),
        (
            "__spans",
            F.when(F.exists("__parts", lambda p: p["kind"].isin(weak)), _linked(F.col("__parts"), reach)).otherwise(
                F.col("__parts")
            ),
        ),
    ]


def scan(docs: DataFrame, text_col: str = "text", reach: int = REACH) -> DataFrame:
    """Add `__spans`, the reported spans of each text as (start, kind, end), sorted.

    Starts and ends count code points, ends are exclusive.
    """
    out = docs.withColumn("__scanned", whole(text_col))
    for name, column in spans(F.col("__scanned"), reach):
        out = out.withColumn(name, column)
    return out.drop("__scanned", "__found", "__parts")


def listed(found: Column, base_only: bool = False) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k.name) for k in KINDS])
    base = [i for i, k in enumerate(KINDS) if not k.weak]
    chosen = F.filter(found, lambda s: s["kind"].isin(base)) if base_only else found
    return F.array_join(
        F.transform(chosen, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
    )


def counted(found: Column, name: str) -> Column:
    place = [k.name for k in KINDS].index(name)
    return F.size(F.filter(found, lambda s: s["kind"] == place)).cast("long")


def redact(text: Column, found: Column, placeholder: str = PLACEHOLDER) -> Column:
    """The text with every stretch of reported spans replaced.

    The text is cut into pieces of PIECE code points once; a stretch between
    spans is put together from them, so that no span walks through the text.
    """

    def cut(row: Column) -> Column:
        upto, pieces = row["upto"], row["pieces"]

        def stretch(first: Column, last: Column) -> Column:
            a, b = F.shiftright(first, PIECE_BITS), F.shiftright(last, PIECE_BITS)
            start = (first - F.shiftleft(a, PIECE_BITS) + 1).cast("int")
            inside = F.substring(F.get(pieces, a), start, (last - first).cast("int"))
            head = F.substring(F.get(pieces, a), start, F.lit(1 << PIECE_BITS))
            between = F.array_join(F.slice(pieces, a + 2, F.greatest(b - a - 1, F.lit(0))), "")
            tail = F.substring(F.coalesce(F.get(pieces, b), F.lit("")), F.lit(1), (last - F.shiftleft(b, PIECE_BITS)).cast("int"))
            return F.when(first >= last, "").when(a == b, inside).otherwise(F.concat(head, between, tail))

        def kept(span: Column, i: Column) -> Column:
            before = F.coalesce(F.get(upto, i - 1), F.lit(0)).cast("int")
            inner = F.concat(stretch(before, span["start"].cast("int")), F.lit(placeholder))
            return F.when((i > 0) & (span["start"] <= before), "").otherwise(inner)

        rest = stretch(F.element_at(upto, -1).cast("int"), F.length(text))
        return F.concat(F.array_join(F.transform(found, kept), ""), rest)

    ends = F.transform(found, lambda s: s["end"])
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{1 << PIECE_BITS}}}"), F.lit(0))
    row = F.struct(running(ends, F.greatest).alias("upto"), pieces.alias("pieces"))
    return F.when(F.size(found) == 0, text).otherwise(let(row, cut))
