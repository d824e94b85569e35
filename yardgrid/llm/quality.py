"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule rejects a document by features of its text, for instance the share of repeated words. Features
are columns that build on one another; each is computed at most once for a row, and only where a rule
that is still to be decided needs it. The rules are ordered on a sample: every rule's rejections and
the work of its features are estimated there, and the rule with the most rejections for its work comes
first. What the rules before it have rejected or computed no longer counts for the next one, so rules
that overlap or share features are placed rightly. The order decides what is computed and which rule
is named; whether a document is kept never depends on it.

The sample is Bernoulli, of ``SAMPLE`` rows on average. Only one row per combination of rejecting rules
(2 to the number of rules at most) reaches the driver. The rows themselves are never shuffled.

Defined results: a null text counts as empty; an empty text has no words and fails the rule on few
words; equal rows get equal results; an empty table stays empty. All columns are kept, a column of the
output's name is replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 4_000
WINDOW = 5
SPACE = r"[\x20\x09-\x0D]"


@dataclass(frozen=True)
class Feature:
    """A column over other features; ``work`` estimates the nanoseconds it takes for a row."""

    needs: tuple[str, ...]
    make: Callable[[], Column]
    work: str


@dataclass(frozen=True)
class Rule:
    """A condition over features under which a document is rejected."""

    name: str
    needs: tuple[str, ...]
    rejects: str


def _window_hashes() -> Column:
    places = F.sequence(F.lit(0), F.size("words") - WINDOW)
    hashed = F.transform(places, lambda i: F.xxhash64(*[F.get("hashes", i + k) for k in range(WINDOW)]))
    return F.when(F.size("words") >= WINDOW, hashed).otherwise(F.array().cast("array<bigint>"))


def _starts() -> Column:
    """Places of windows that occur more than once, in order: neighbours in the order of hashes."""

    def again(entry: Column, k: Column) -> Column:
        sides = [F.get("ordered", k + step)["hash"] == entry["hash"] for step in (-1, 1)]
        return F.coalesce(sides[0], F.lit(False)) | F.coalesce(sides[1], F.lit(False))

    return F.sort_array(F.transform(F.filter("ordered", again), lambda e: e["place"]))


def _covered() -> Column:
    """Words in the windows at these places; neighbouring windows share words."""
    steps = F.transform(
        "starts", lambda s, k: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", k + 1) - s, F.lit(WINDOW)))
    )
    return F.coalesce(F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, b: a + b), F.lit(0))


def _pairs() -> Column:
    pairs = F.transform("windows", lambda h, i: F.struct(h.alias("hash"), i.alias("place")))
    return F.when(F.col("repeats"), F.sort_array(pairs))


def _lines() -> Column:
    return F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


FEATURES: dict[str, Feature] = {
    "words": Feature((), lambda: F.array_remove(F.split("text", f"{SPACE}+"), ""), "38 * length(text)"),
    "n_words": Feature(("words",), lambda: F.size("words").cast("bigint"), "10"),
    "word_chars": Feature(
        ("words",), lambda: F.length(F.array_join("words", "")).cast("bigint"), "20 * length(text)"
    ),
    "n_symbols": Feature(
        (), lambda: F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("bigint"), "18 * length(text)"
    ),
    "lines": Feature((), _lines, "9 * length(text)"),
    "n_lines": Feature(("lines",), lambda: F.size("lines").cast("bigint"), "10"),
    "n_dup_lines": Feature(
        ("lines",), lambda: (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint"), "3 * length(text)"
    ),
    "hashes": Feature(("words",), lambda: F.transform("words", lambda w: F.xxhash64(w)), "22 * length(text)"),
    "windows": Feature(("words", "hashes"), _window_hashes, "92 * length(text)"),
    "repeats": Feature(
        ("windows",), lambda: F.size(F.array_distinct("windows")) < F.size("windows"), "5 * length(text)"
    ),
    "ordered": Feature(("windows", "repeats"), _pairs, "if(repeats, 120, 2) * length(text)"),
    "starts": Feature(("ordered",), _starts, "if(repeats, 200, 2) * length(text)"),
    "n_repeat_words": Feature(("starts",), _covered, "if(repeats, 20, 1) * length(text)"),
    "n_letters": Feature((), lambda: F.regexp_count("text", F.lit(r"[\p{L}\p{M}]")).cast("bigint"), "110 * length(text)"),
    "n_capitals": Feature((), lambda: F.regexp_count("text", F.lit(r"\p{Lu}")).cast("bigint"), "19 * length(text)"),
}

RULES: tuple[Rule, ...] = (
    Rule("few_words", ("n_words",), "n_words < 10"),
    Rule("repeated_words", ("n_words", "n_repeat_words"), "100 * n_repeat_words > 20 * n_words"),
    Rule(
        "word_length", ("n_words", "word_chars"), "word_chars < 3 * n_words or word_chars > 10 * n_words"
    ),
    Rule("symbols", ("n_words", "n_symbols"), "10 * n_symbols > n_words"),
    Rule("repeated_lines", ("n_lines", "n_dup_lines"), "2 * n_dup_lines > n_lines"),
    Rule("few_letters", ("word_chars", "n_letters"), "2 * n_letters < word_chars"),
    Rule("capitals", ("n_letters", "n_capitals"), "2 * n_capitals > n_letters"),
)


def closure(names: Sequence[str], have: Sequence[str] = ()) -> list[str]:
    """The features to compute for these, each after those it builds on."""
    out: list[str] = []

    def visit(name: str) -> None:
        if name not in have and name not in out:
            for need in FEATURES[name].needs:
                visit(need)
            out.append(name)

    for name in names:
        visit(name)
    return out


def _with(df: DataFrame, names: Sequence[str], where: str | None = None) -> DataFrame:
    """The table with more features, null where the condition does not hold."""
    for name in names:
        value = FEATURES[name].make()
        df = df.withColumn(name, value if where is None else F.when(F.col(where), value))
    return df


def estimate_order(
    df: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, report: Sequence[str] = (),
    sample: int = SAMPLE, seed: int = 1,
) -> list[Rule]:
    """The rules by rejections for their work, estimated on a sample.

    Features in ``report`` are computed for every row anyway and cost a rule nothing.
    """
    share = min(1.0, sample / max(1, df.count()))
    texts = df.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).sample(share, seed)
    names = closure([n for rule in rules for n in rule.needs])
    rejected = [F.coalesce(F.expr(r.rejects), F.lit(False)).alias(f"r{k}") for k, r in enumerate(rules)]
    work = [F.expr(FEATURES[n].work).cast("double").alias(f"w{k}") for k, n in enumerate(names)]
    patterns = (
        _with(texts, names)
        .select(*rejected, *work)
        .groupBy(*[f"r{k}" for k in range(len(rules))])
        .agg(F.count(F.lit(1)).alias("rows"), *[F.sum(f"w{k}").alias(f"w{k}") for k in range(len(names))])
        .collect()
    )  # one row per combination of rejecting rules
    alive, have, left, order = list(patterns), closure(report), list(rules), []
    while left:

        def gain(rule: Rule) -> float:
            k = rules.index(rule)
            todo = [names.index(n) for n in closure(rule.needs, have)]
            spent = sum(p["rows"] + sum(p[f"w{n}"] for n in todo) for p in alive)
            return sum(p["rows"] for p in alive if p[f"r{k}"]) / max(1.0, spent)

        best = max(left, key=gain)  # of equal ones the one given first
        order.append(best)
        left.remove(best)
        have = have + closure(best.needs, have)
        alive = [p for p in alive if not p[f"r{rules.index(best)}"]]
    return order


def apply_rules(
    df: DataFrame, order: Sequence[Rule], text: str = "text", report: Sequence[str] = (), out: str = "quality"
) -> DataFrame:
    """``df`` with a column ``out``: the reported features, ``failed_rule`` and ``kept``.

    ``failed_rule`` is the first rule in the order that rejects the row, null where it is kept. After
    it no further feature of the row is computed.
    """
    columns = [c for c in df.columns if c.lower() != out.lower()]
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    have = closure(report)
    rows = _with(rows, have)
    last: dict[str, int] = {}  # the last rule that needs a feature
    for k, rule in enumerate(order):
        for name in closure(rule.needs):
            last[name] = k
    alive: str | None = None
    for k, rule in enumerate(order):
        todo = closure(rule.needs, have)
        rows, have = _with(rows, todo, alive), have + todo
        passes = ~F.coalesce(F.expr(rule.rejects), F.lit(False))
        rows = rows.withColumn(f"pass_{k}", passes if alive is None else F.col(alive) & passes)
        alive = f"pass_{k}"
        rows = rows.drop(*[n for n in have if n not in report and last.get(n, -1) <= k])
    named = [F.when(~F.col(f"pass_{k}"), F.lit(rule.name)) for k, rule in enumerate(order)]
    first = F.coalesce(*named, F.lit(None).cast("string"))
    # A filter on the verdict pushed below the features would repeat each of them for every use, and
    # so on down their chain. Spark pushes no filter below an expression that is not deterministic.
    kept = (F.col(alive) if alive else F.lit(True)) & (F.spark_partition_id() >= 0)
    found = F.struct(*report, first.alias("failed_rule"), kept.alias("kept"))
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in columns], found.alias(out))


def keep_good(df: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The documents that no rule rejects, with the columns they came with."""
    order = estimate_order(df, text, rules)
    return apply_rules(df, order, text, out="_quality").filter("_quality.kept").drop("_quality")
