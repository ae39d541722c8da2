"""Quality rules as a short-circuit cascade, in column expressions only.

A rule rejects a text by metrics that it works out itself, from the text and its words. On a bounded sample the cascade
measures what a rule costs by itself, metrics included, and what share it rejects; it orders the rules by rejection per cost
and evaluates them as one CASE over the words, which are found once: a text that a rule rejects never pays for the rules after
it. The order never changes the verdict. `decisions` reports every metric of every row, so there the rules read them ready-made.

Words are runs of characters other than \x20 and \x09-\x0D. Null text has no words, and fails. Rows that repeat are judged each.
Very long texts are judged whole; equal three-word windows are equal 64-bit hashes. Other columns are left as they are,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: signs counted as symbols.
SYMBOLS = "#*$%&|<>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once: a lambda's variable, not an expression copied to each use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _text(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def words_of(t: Column) -> Column:
    # split() keeps an empty string before leading white space and after trailing white space
    return F.array_remove(F.split(t, r"[\x20\x09-\x0D]+"), "")


def _windows(w: Column) -> Column:
    """A hash of each three words in a row."""
    return F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, w[i + 1], w[i + 2]))


def _repeats(h: Column) -> Column:
    """How many windows are not the first of their kind: linear in them."""
    return F.size(h) - F.size(F.array_distinct(h))


def _covered(h: Column) -> Column:
    """Words in windows found twice or more: windows are sorted by hash, with their places."""
    after = lambda x: F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0)))

    def places(s: Column) -> Column:
        # windows equal to a neighbour in hash order: both of each equal pair
        both = F.zip_with(F.slice(s, 1, F.size(s) - 1), after(s), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
        return F.sort_array(F.array_distinct(F.flatten(F.filter(both, lambda x: x.isNotNull()))))

    def words(p: Column) -> Column:
        # a window covers three words; one that starts k < 3 words after another adds k
        steps = F.zip_with(F.slice(p, 1, F.size(p) - 1), after(p), lambda a, b: F.least(b - a, F.lit(3)))
        return F.aggregate(steps, F.lit(3), lambda acc, x: acc + x)

    return _let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), lambda s: _let(places(s), words))


def _word_chars(w: Column) -> Column:
    return F.length(F.array_join(w, ""))


def _symbol_count(t: Column) -> Column:
    return F.when(t.rlike(f"[{SYMBOLS}]"), F.length(F.regexp_replace(t, f"[^{SYMBOLS}]+", ""))).otherwise(0)


def _lines(t: Column) -> Column:
    """(lines with a word, those equal to an earlier one)."""
    held = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return _let(held, lambda ln: F.struct(F.size(ln).cast("long").alias("n"), (F.size(ln) - F.size(F.array_distinct(ln))).cast("long").alias("dup")))


class Rule(NamedTuple):
    """by: rejects a text, from (text, words). of: the same, from the metrics of a row."""

    by: Callable[[Column, Column], Column]
    of: Callable[[Column], Column]


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def _base(t: Column, w: Column) -> Column:
    # a window that is not the first of its kind makes two repeated at most, of three words each: most texts end at this bound
    bound = lambda h: (600 * _repeats(h) > 50 * F.size(w)) & (100 * _covered(h) > 50 * F.size(w))
    return (F.size(w) < 50) | _let(_windows(w), bound)


def _word_length(t: Column, w: Column) -> Column:
    return _let(_word_chars(w), lambda n: (n < 2 * F.size(w)) | (n > 20 * F.size(w)))


def _symbols(t: Column, w: Column) -> Column:
    return 10 * _symbol_count(t) > F.size(w)


def _dup_lines(t: Column, w: Column) -> Column:
    return t.contains("\n") & _let(_lines(t), lambda x: 10 * x["dup"] > 3 * x["n"])


def _no_letter(t: Column) -> Column:
    return ~t.rlike(r"\p{L}")


def _shouting(t: Column) -> Column:
    return (F.upper(t) == t) & t.rlike(r"\p{Lu}")


#: name -> rule. Thresholds leave ordinary prose alone.
RULES: dict[str, Rule] = {
    "base": Rule(_base, base_failed),
    "symbols": Rule(_symbols, lambda m: 10 * m["n_symbols"] > m["n_words"]),
    "dup_lines": Rule(_dup_lines, lambda m: 10 * m["n_dup_lines"] > 3 * m["n_lines"]),
    "word_length": Rule(_word_length, lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 20 * m["n_words"])),
    "no_letter": Rule(lambda t, w: _no_letter(t), lambda m: _no_letter(m["text"])),
    "shouting": Rule(lambda t, w: _shouting(t), lambda m: _shouting(m["text"])),
}


def _case(tests: list[tuple[str, Column]]) -> Column:
    """Null where no test holds, else the name of the first that does; those after it are not evaluated."""
    out = F.lit(None).cast("string")
    for name, test in reversed(tests):
        out = F.when(F.coalesce(test, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def verdict(text: Column, order: list[str], rules: dict[str, Rule] | None = None) -> Column:
    """The name of the first rule of the order that rejects the text, or null."""
    rules = rules or RULES
    return _let(words_of(text), lambda w: _case([(name, rules[name].by(text, w)) for name in order]))


def order_rules(df: DataFrame, text_col: str = "text", rules: dict[str, Rule] | None = None, sample_rows: int = 1000, seed: int = 7, repeats: int = 2) -> list[dict]:
    """Rules with their cost (seconds a row, less those of a job that only finds words) and rejection share on about sample_rows
    rows, best first. A rule's time is the least of some runs, the first of which also compiles it and does not count.

    The sample is of fixed size at any input, and only orders the cascade; to draw it, the texts are read once.
    """
    rules = rules or RULES
    rows = df.count()
    share = min(1.0, sample_rows / rows) if rows else 1.0
    part = df.select(_text(df[text_col]).alias("t")).sample(fraction=share, seed=seed).coalesce(4).cache()
    n = part.count()

    def run(test) -> tuple[float, int]:
        job = part.agg(F.sum(_let(words_of(F.col("t")), lambda w: F.coalesce(test(F.col("t"), w), F.lit(False))).cast("long")).alias("x"))
        took = []
        for _ in range(1 + repeats):
            began = time.perf_counter()
            hit = job.first()["x"] or 0
            took.append(time.perf_counter() - began)
        return min(took[1:]), hit

    found = []
    if n:
        idle, _ = run(lambda t, w: F.size(w) < 0)
        for name, rule in rules.items():
            took, hit = run(rule.by)
            found.append({"rule": name, "cost": max(took - idle, 1e-3) / n, "rejects": hit / n})
    part.unpersist()
    return sorted(found, key=lambda x: (-x["rejects"] / x["cost"], x["cost"], x["rule"])) or [{"rule": name, "cost": 0.0, "rejects": 0.0} for name in rules]


def _order(df: DataFrame, text_col: str, rules: dict[str, Rule] | None) -> list[str]:
    return [x["rule"] for x in order_rules(df, text_col, rules)]


def cascade(df: DataFrame, text_col: str = "text", rules: dict[str, Rule] | None = None, to: str = "rejected_by") -> DataFrame:
    """df with one more column: the rule that rejects the row, null where it is kept."""
    if to in df.columns:
        raise ValueError(f"there is a column {to}")
    # a generator, not a projection: a filter above cannot be rewritten into a copy of the rules
    return df.select("*", F.explode(F.array(verdict(_text(df[text_col]), _order(df, text_col, rules), rules))).alias(to))


def kept(df: DataFrame, text_col: str = "text", rules: dict[str, Rule] | None = None) -> DataFrame:
    """df's own columns, without the rows that a rule rejects."""
    return df.filter(verdict(_text(df[text_col]), _order(df, text_col, rules), rules).isNull())


def metrics(text: Column) -> Column:
    """A struct of all metrics of a text, and the text."""

    def of(w: Column) -> Column:
        repeated = _let(_windows(w), lambda h: F.when(_repeats(h) > 0, _covered(h)).otherwise(0))
        lines = F.when(text.contains("\n"), _lines(text)).otherwise(F.struct(F.least(F.size(w), F.lit(1)).cast("long").alias("n"), F.lit(0).cast("long").alias("dup")))
        return _let(
            lines,
            lambda ln: F.struct(
                F.size(w).cast("long").alias("n_words"),
                _word_chars(w).cast("long").alias("word_chars"),
                _symbol_count(text).cast("long").alias("n_symbols"),
                ln["dup"].alias("n_dup_lines"),
                repeated.cast("long").alias("n_repeat_words"),
                ln["n"].alias("n_lines"),
                text.alias("text"),
            ),
        )

    return _let(words_of(text), of)


def decisions(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    order = _order(df, text_col, None)
    out = df.select(df[id_col].alias("doc_id"), F.explode(F.array(metrics(_text(df[text_col])))).alias("m"))
    m = F.col("m")
    first = _case([(name, RULES[name].of(m)) for name in order])
    return out.select("doc_id", *(m[x].alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), base_failed(m).alias("base_failed"), first.isNull().alias("kept"))
