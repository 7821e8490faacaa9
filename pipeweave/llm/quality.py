"""Operator 10: document quality by weak supervision, in DataFrame expressions only.

Several rules look at each document and vote good (1), bad (-1) or abstain (0). Nobody says how far a
rule can be trusted: expectation-maximisation estimates each rule's accuracy and the share of good
documents from how the votes agree, and the posterior probability decides, instead of a demand that
every rule passes. Each rule has one vote and a feature of its own (length, symbols, capitals, letters and
digits, words without them, repeated phrases, repeated lines), as the estimate takes votes to be independent given the
class. Junk comes in kinds that break few rules each; what ties the kinds to one class are rules that
several of them break.

Rows: one per input row, in any order, with the input's columns. Null text counts as empty: no words,
base_failed is true. Repeated rows are judged alike. An empty table gives an empty table. Columns
of the input that have the name of an output column are replaced by it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipeweave.llm.names import fresh
from pipeweave.llm.storage import Scratch

#: The six ASCII blanks; everything else belongs to words.
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE_FEATURES = ("n_capitals", "n_alnum", "n_bare_words")
#: A word without a letter or digit.
_BARE = r"(?<![^\x20\x09-\x0D])[^\p{L}\p{N}\x20\x09-\x0D]++(?![^\x20\x09-\x0D])"
#: Bits for a place in a text that is sorted together with hash bits; texts of more windows are sorted by structs.
PLACE_BITS = 24


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also when body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _hashes(words: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))


def _repeated(hashes: Column, places: Column, bits: str) -> Column:
    """Those of the places whose windows have the same low or high hash bits, 40 of them, as another's.

    The bits are sorted together with the place, PLACE_BITS of one long, so that equal ones are neighbours.
    """
    part = (lambda x: F.shiftleft(x, PLACE_BITS)) if bits == "low" else (lambda x: x.bitwiseAND(F.lit(-(1 << PLACE_BITS))))
    same = lambda x, y: F.coalesce(F.shiftright(x.bitwiseXOR(y), PLACE_BITS) == 0, F.lit(False))
    return let(
        F.sort_array(F.transform(places, lambda i: part(F.get(hashes, i)).bitwiseOR(i.cast("long")))),
        lambda s: F.transform(
            F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1))),
            lambda x: x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int"),
        ),
    )


def _repeated_long(hashes: Column) -> Column:
    """The places of windows that occur twice or more, in texts of any length."""
    same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    return let(
        F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        lambda s: F.transform(F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1))), lambda x: x["i"]),
    )


def _covered(places: Column) -> Column:
    """How many words the windows at these places cover together."""
    return let(
        F.sort_array(places),
        lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.coalesce(F.least(F.get(p, i + 1) - x, F.lit(3)), F.lit(3))).cast("array<long>"),
            F.lit(0).cast("long"),
            lambda a, x: a + x,
        ),
    )


def repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more in the text.

    Windows are compared by 64-bit hashes. Most texts repeat none, which a hash set shows; the others
    are sorted by 40 of the bits, and those that repeat by the 40 at the other end, or, where places do not
    fit beside the bits, by hash and place as they are.
    """
    none = F.lit(0).cast("long")
    places = lambda h: F.sequence(F.lit(0), F.size(h) - 1)
    fitting = lambda h: let(_repeated(h, places(h), "low"), lambda p: F.when(F.size(p) == 0, p).otherwise(_repeated(h, p, "high")))
    some = lambda h: _covered(F.when(F.size(h) <= 1 << PLACE_BITS, fitting(h)).otherwise(_repeated_long(h)))
    return F.when(F.size(words) < 4, none).otherwise(
        let(_hashes(words), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(some(h)))
    )


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the FEATURES and MORE_FEATURES (long) and base_failed (boolean). One pass over the texts, no shuffle."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def without(chars: str) -> Column:
        out = t
        for c in chars:
            out = F.replace(out, F.lit(c), F.lit(""))
        return out

    counted = lambda w: F.struct(
        F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("c"), repeat_words(w).alias("r")
    )
    (words,) = fresh(docs, "_words")
    out = docs.withColumns(
        {
            words: let(words_of(t), counted),
            "n_symbols": F.when(t.rlike(f"[{SYMBOLS}]"), F.length(t) - F.length(without(SYMBOLS))).otherwise(0).cast("long"),
            "n_capitals": F.length(F.regexp_replace(t, r"\P{Lu}+", "")).cast("long"),
            "n_alnum": F.length(F.regexp_replace(t, r"[^\p{L}\p{N}]+", "")).cast("long"),
            "n_bare_words": F.regexp_count(t, F.lit(_BARE)).cast("long"),
            "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        }
    )
    out = out.withColumns({"n_words": F.col(f"{words}.n"), "word_chars": F.col(f"{words}.c"), "n_repeat_words": F.col(f"{words}.r")}).drop(words)
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


@dataclass(frozen=True)
class Rule:
    """A rule on feature columns: SQL conditions for a vote that a document is bad or good; else it abstains."""

    name: str
    bad: str
    good: str


#: Thresholds of common web-corpus heuristics; between them a rule has no opinion.
RULES = (
    Rule("length", "n_words < 20", "n_words >= 50"),
    Rule("symbols", "10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    Rule("capitals", "10 * n_capitals > 3 * word_chars", "10 * n_capitals <= word_chars"),
    Rule("letters", "100 * n_alnum < 80 * word_chars", "100 * n_alnum >= 90 * word_chars"),
    Rule("bare_words", "5 * n_bare_words > n_words", "20 * n_bare_words <= n_words"),
    Rule("repeats", "100 * n_repeat_words > 40 * n_words", "100 * n_repeat_words <= 20 * n_words"),
    Rule("lines", "n_dup_lines > 8", "n_dup_lines <= 2"),
)


def votes(rules: tuple[Rule, ...]) -> Column:
    """One int for each rule: 0 bad, 1 abstains, 2 good."""
    return F.array(*[F.when(F.expr(r.bad), 0).when(F.expr(r.good), 2).otherwise(1) for r in rules])


def _posterior(state: Column, cast: Column, n_rules: int) -> Column:
    """Probability of good, by rules that are independent given the class."""

    def fit(good: int) -> Column:
        at = good * 3 * n_rules
        return F.aggregate(
            F.transform(cast, lambda v, r: F.log(F.get(state["rate"], r * 3 + v + at))), F.lit(0.0), lambda a, x: a + x
        )

    return 1.0 / (1.0 + F.exp(fit(0) + F.log(1 - state["good"]) - fit(1) - F.log(state["good"])))


def estimate(patterns: DataFrame, n_rules: int, rounds: int = 40) -> tuple[float, list[float]]:
    """The share of good documents and each rule's vote rates by class, by expectation-maximisation.

    patterns: votes and n, how many documents cast them; 3 ** n_rules rows at most, whatever the number
    of documents. Rates start from rules that are right more often than wrong, which settles which class
    is called good, with junk that breaks few rules, and are smoothed by one document, so that no vote ever
    proves anything.
    """
    start = [0.30, 0.20, 0.50] * n_rules + [0.02, 0.08, 0.90] * n_rules
    state = F.struct(F.lit(0.8).alias("good"), F.array(*map(F.lit, start)).alias("rate"))

    def step(s: Column, rows: Column) -> Column:
        weighed = F.transform(
            rows, lambda x: F.struct(x["votes"].alias("votes"), x["n"].alias("n"), (x["n"] * _posterior(s, x["votes"], n_rules)).alias("g"))
        )

        def maximise(w: Column) -> Column:
            add = lambda pick: F.aggregate(w, F.lit(0.0), lambda a, x: a + pick(x))
            good, bad = add(lambda x: x["g"]), add(lambda x: x["n"] - x["g"])
            rates = []
            for of, total in ((lambda x: x["n"] - x["g"], bad), (lambda x: x["g"], good)):
                for r in range(n_rules):
                    for v in range(3):
                        hit = add(lambda x, of=of, r=r, v=v: F.when(x["votes"][r] == v, of(x)).otherwise(0.0))
                        rates.append((hit + 1.0) / (total + 3.0))
            return F.struct(((good + 1.0) / (good + bad + 2.0)).alias("good"), F.array(*rates).alias("rate"))

        return let(weighed, maximise)

    one = patterns.agg(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n"))).alias("rows"))
    found = one.select(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), state, lambda s, _: step(s, F.col("rows"))).alias("s")).first()
    return found.s.good, list(found.s.rate)


def judge(docs: DataFrame, scratch: Scratch, rules: tuple[Rule, ...] = RULES, keep_from: float = 0.5, text: str = "text") -> DataFrame:
    """docs without the text, plus FEATURES, MORE_FEATURES, base_failed, p_good (double) and kept (boolean).

    kept: not base_failed, and p_good >= keep_from. The features are written once; vote patterns are
    counted before the shuffle.
    """
    table = scratch.keep(features(docs, text).drop(text), "features")
    good, rate = estimate(table.groupBy(votes(rules).alias("votes")).agg(F.count(F.lit(1)).alias("n")), len(rules))
    state = {"good": F.lit(good), "rate": F.array(*map(F.lit, rate))}
    out = table.withColumn("p_good", _posterior(state, votes(rules), len(rules)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= keep_from))
