"""Secret scans: three rules, and the entropy of what looks random.

All of it is Spark expressions on one row: no shuffle, no Python on executors.
Strings of a character class are candidates; a window slides over each, the
counts of its characters changing by the one that enters and the one that
leaves, and a candidate with a window of high Shannon entropy is a secret,
unless the allow-list knows it as something else."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """Leftmost matches of a pattern that don't overlap; those stay whose group has at least so many characters."""

    kind: str
    pattern: str
    group: int
    least: int


#: The kinds of the base rules in their order, with what each must have.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # Runs of under 24 are dropped, and no match can begin in one: so they needn't be matched.
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)


@dataclass(frozen=True)
class CharacterClass:
    """Candidates of a class are whole runs of it; a window of so many characters has to have so many bits a character."""

    kind: str
    pattern: str
    alphabet: str
    window: int
    bits: float


LETTERS = "abcdefghijklmnopqrstuvwxyz"
CLASSES = (
    CharacterClass("random_hex", r"(?<![0-9A-Za-z])(?:[0-9a-f]{16,}|[0-9A-F]{16,})(?![0-9A-Za-z])", "0123456789abcdefABCDEF", 16, 2.9),
    CharacterClass("random_base64", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}", f"{LETTERS}{LETTERS.upper()}0123456789+/_-", 20, 3.7),
)
KINDS = (*(r.kind for r in RULES), *(c.kind for c in CLASSES))

#: The allow-list: candidates that one of these matches are no secrets.  No group is repeated without a bound, so that
#: Java matches the longest candidates without recursion.
ALLOWED = (
    r"^[0-9]+$",  # numbers
    r"^[A-Za-z+/_-]+$",  # words, names and paths, without any digit
    r"^(?=(?:[^/_-]*[/_-]){3})[a-z0-9/_-]+$",  # slugs and paths: lower-case words and numbers between three separators or more
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",  # UUIDs
    r"^sha(?:1|256|384|512)-",  # digests that say so
    r"(?i)example|sample|dummy|placeholder|xxxx|0123456789|abcdefghij",  # made up
)

#: n * log2(n) of a count is kept in whole steps of this, so that sums don't depend on their order.
STEPS = 1 << 20
#: Numbers that are summed in one go; longer arrays are summed in two levels.
RUN = 256

SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once: an expression inside a lambda would be computed for each entry."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_sums(numbers: Column) -> Column:
    """The sums up to each entry of an array of bigint.  Blocks of RUN, then over their sums: no array is copied for each entry."""
    zero = F.lit(0).cast("bigint")

    def grown(block: Column, start: Column) -> Column:
        """start, and it with each of the block's entries added in turn."""
        return F.aggregate(block, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    def in_blocks(own: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(own) - 1) / RUN).cast("int")), lambda k: F.slice(own, k * RUN + 1, RUN))

    def joined(blocks: Column) -> Column:
        before = grown(F.transform(blocks, lambda b: F.aggregate(b, zero, lambda acc, x: acc + x)), zero)
        return F.flatten(F.zip_with(blocks, F.slice(before, F.lit(1), F.size(blocks)), lambda b, start: F.slice(grown(b, start), 2, RUN)))

    return let(numbers, lambda own: F.when(F.size(own) > 0, let(in_blocks(own), joined)).otherwise(F.array().cast("array<bigint>")))


def high_entropy(candidate: Column, kind: CharacterClass) -> Column:
    """(first, last): the first character of the first window of high entropy, the last one of the last; -1 if there is none.

    The window's state is a count for each character of the class and the sum
    of n * log2(n) over them, from which the entropy is log2(window) - sum / window.
    """
    size, width = kind.window, len(kind.alphabet)
    table = F.array(*[F.lit(round(n * math.log2(n) * STEPS) if n else 0).cast("bigint") for n in range(size + 1)])
    most = round((math.log2(size) - kind.bits) * size * STEPS)
    of = lambda n: F.get(table, n)
    codes = F.transform(F.slice(F.split(candidate, ""), F.lit(1), F.length(candidate)), lambda c: F.instr(F.lit(kind.alphabet), c) - 1)
    # Each place with the character that enters and the one that leaves, -1 for none.
    moves = let(codes, lambda own: F.transform(own, lambda c, i: F.struct(i.alias("at"), c.alias("enters"), F.when(i >= size, F.get(own, i - size)).otherwise(-1).alias("leaves"))))
    start = F.struct(F.array_repeat(F.lit(0), width).alias("counts"), F.lit(0).cast("bigint").alias("sum"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))

    def slide(state: Column, move: Column) -> Column:
        same = move["enters"] == move["leaves"]
        more, fewer = F.get(state["counts"], move["enters"]), F.get(state["counts"], move["leaves"])
        left = F.when(move["leaves"] >= 0, of(fewer - 1) - of(fewer)).otherwise(F.lit(0).cast("bigint"))
        total = F.when(same, state["sum"]).otherwise(state["sum"] + of(more + 1) - of(more) + left)
        counts = F.when(same, state["counts"]).otherwise(F.transform(state["counts"], lambda n, k: n + (k == move["enters"]).cast("int") - (k == move["leaves"]).cast("int")))
        hot = (move["at"] >= size - 1) & (total <= most)
        first = F.when(hot & (state["first"] < 0), move["at"] - size + 1).otherwise(state["first"])
        return F.struct(counts.alias("counts"), total.alias("sum"), first.alias("first"), F.when(hot, move["at"]).otherwise(state["last"]).alias("last"))

    return F.aggregate(moves, start, slide, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))


def _places(text: Column, pattern: str, found: Column) -> Column:
    """Where each of the pattern's matches in text ends, in code points: after what lies between them and they themselves."""
    between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    return running_sums(F.zip_with(between, found, lambda gap, match: (F.length(gap) + F.length(match)).cast("bigint")))


def _span(start: Column, k: int, end: Column, good: Column) -> Column:
    return F.struct(start.alias("start"), F.lit(k).alias("kind"), end.alias("end"), good.alias("good"))


def _good(k: int, spans: Column) -> Column:
    """The good ones, or none where nothing of kind k was found."""
    clean = F.transform(F.filter(spans, lambda s: s["good"]), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return F.when(F.size(f"_{k}") > 0, clean).otherwise(F.array().cast(SPAN))


def _rule_spans(k: int, rule: Rule) -> Column:
    own, ends = F.col(f"_{k}"), F.col(f"_{k}_ends")
    inner = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.group)) if rule.group else own
    both = F.arrays_zip(own.alias("m"), inner.alias("g"))
    return _good(k, F.zip_with(both, ends, lambda m, end: _span(end - F.length(m["m"]), k, end, F.length(m["g"]) >= rule.least)))


def _class_spans(k: int, kind: CharacterClass) -> Column:
    """The allow-list is asked first: windows slide over the others alone."""
    own, ends = F.col(f"_{k}"), F.col(f"_{k}_ends")
    allowed = lambda text: F.coalesce(*[F.when(text.rlike(p), F.lit(True)) for p in ALLOWED], F.lit(False))
    suspect = F.filter(F.arrays_zip(own.alias("m"), ends.alias("end")), lambda s: ~allowed(s["m"]))
    windows = F.transform(suspect, lambda s: F.struct((s["end"] - F.length(s["m"])).alias("start"), high_entropy(s["m"], kind).alias("w")))
    return _good(k, F.transform(windows, lambda s: _span(s["start"] + s["w"]["first"], k, s["start"] + s["w"]["last"] + 1, s["w"]["last"] >= 0)))


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): of each input row the secrets as [start, end) in code points, with the number of the kind (KINDS), by start and kind.

    RULES first; the spans of CLASSES are added to theirs, which all stay, and
    may overlap them.  Whole texts are scanned, whatever their length.  Null
    and empty texts have no spans; repeated rows each get a row; null ids stay;
    an empty table gives no rows.  One stage, no shuffle.
    """
    text = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names = [(f"_{k}", x.pattern) for k, x in enumerate((*RULES, *CLASSES))]
    found = text.select("*", *[F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(n) for n, p in names])
    placed = found.select("*", *[F.when(F.size(n) > 0, _places(F.col("text"), p, F.col(n))).alias(f"{n}_ends") for n, p in names])
    spans = [_rule_spans(k, r) for k, r in enumerate(RULES)] + [_class_spans(k, c) for k, c in enumerate(CLASSES, len(RULES))]
    return placed.select("doc_id", F.sort_array(F.concat(*spans)).alias("spans"))


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """The report columns of find_secrets' rows."""
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{r.kind}") for k, r in enumerate(RULES)],
        F.sha2(spans_text(F.filter("spans", lambda s: s["kind"] < len(RULES))), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
    )
