"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation weighs them. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import read, written

SPACE = "\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def _repeated_words(words: str) -> Column:
    """Words in three-word windows found twice or more in the array named words, in n log n steps."""
    spread = "transform(sequence(0, size({w}) - 3), i -> xxhash64({w}[i], {w}[i + 1], {w}[i + 2]))"
    hashes = spread.format(w=words)
    sorted_ = "array_sort(transform(h, (x, i) -> struct(x as x, i as i)))"
    hit = "filter(transform(s, (e, k) -> if(coalesce(e.x = get(s, k - 1).x, false) or coalesce(e.x = get(s, k + 1).x, false), e.i, null)), p -> p is not null)"
    cover = "aggregate(transform(p, (x, k) -> if(k = 0, 3, least(3, x - get(p, k - 1)))), 0, (a, b) -> a + b)"
    let = lambda name, value, body: f"element_at(transform(array({value}), {name} -> {body}), 1)"
    many = let("s", sorted_, let("p", f"sort_array({hit})", cover))
    return F.expr(f"if(size({words}) < 4, 0, {let('h', hashes, f'if(size(array_distinct(h)) = size(h), 0, {many})')})")


def features(docs: DataFrame) -> DataFrame:
    """doc_id and what the rules look at, of the whole text; null texts count as empty, repeated rows each; other columns are not read; no rows give none."""
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = F.translate(text, SPACE, " " * len(SPACE))
    words = F.filter(F.split(plain, " "), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, " " + SPACE, "") != "")
    got = docs.select("doc_id", text.alias("text"), words.alias("words"), lines.alias("lines"))
    word_chars = F.length(F.translate("text", " " + SPACE, ""))
    return got.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        word_chars.cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated_words("words").cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        (F.length("text") - F.length(F.translate("text", "!?{}[]=_~^\\", ""))).cast("long").alias("n_marks"),
        F.length(F.regexp_replace("text", r"[^\p{Lu}]", "")).cast("long").alias("n_upper"),
        sum(F.contains("text", F.lit(c)).cast("long") for c in SYMBOLS).alias("n_symbol_kinds"),
        F.size(F.filter("words", lambda w: F.translate(w, SYMBOLS, "") == "")).cast("long").alias("n_symbol_words"),
    )


def votes() -> dict[str, Column]:
    """Rule -> 1 (good), 0 (bad) or null (abstains), on features(). Each abstains between its two bounds, or where a text is too short to tell."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    rule = lambda bad, good: F.when(bad, 0).when(good, 1)
    long = F.col("n_words") >= 20
    return {
        "length": rule(F.col("n_words") < 15, F.col("n_words") >= 80),
        "word_length": rule((chars / n < 2) | (chars / n > 14), (chars / n).between(3, 10)),
        "symbols": rule(F.col("n_symbols") > 0.1 * n, F.col("n_symbols") <= 0.02 * n),
        "symbol_kinds": rule(F.col("n_symbol_kinds") >= 4, F.col("n_symbol_kinds") <= 1),
        "symbol_words": rule(F.col("n_symbol_words") > 0.05 * n, F.col("n_symbol_words") <= 0.01 * n),
        "lines": rule((F.col("n_dup_lines") >= 3) & (F.col("n_dup_lines") > 0.3 * F.col("n_lines")), F.col("n_dup_lines") <= 0.1 * F.col("n_lines")),
        "repeats": rule(F.col("n_repeat_words") > 0.4 * n, F.col("n_repeat_words") <= 0.2 * n),
        "variety": rule(long & (F.col("n_distinct") < 0.2 * n), long & (F.col("n_distinct") >= 0.35 * n)),
        "marks": rule(F.col("n_marks") > 0.2 * n, F.col("n_marks") <= 0.1 * n),
        "upper": rule(F.col("n_upper") > 0.4 * chars, F.col("n_upper") <= 0.15 * chars),
    }


#: Prior beliefs, as counts of votes (bad, good) of a rule: on good documents, on bad ones, and on bad ones of a kind that the rule has revealed. They
#: say which class is which and weigh no more than so many documents.
ON_GOOD, ON_BAD, ON_OWN = (1.0, 19.0), (4.0, 16.0), (16.0, 4.0)
#: Rules that agree on defects by this log-likelihood ratio above chance, and twice as often at least, reveal a kind of bad documents.
SURE = 12.0


@dataclass
class Kinds:
    """Class 0 is the good documents, the others are kinds of bad ones. shares: of each class; bad: [class, rule], the chance of a bad vote if the rule votes."""

    shares: np.ndarray
    bad: np.ndarray

    def joint(self, bad: np.ndarray, good: np.ndarray) -> np.ndarray:
        """Chances of each class, given rows of bad and good votes; rules that abstain say nothing."""
        odds = np.log(self.shares) + bad @ np.log(self.bad).T + good @ np.log1p(-self.bad).T
        p = np.exp(odds - odds.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def posterior(self, votes: list[tuple]) -> np.ndarray:
        """The chance that a document with these votes is good."""
        return self.joint(*_votes(votes, self.bad.shape[1]))[:, 0]


def _votes(votes: list[tuple], rules: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.array([[-1 if v is None else v for v in row] for row in votes], np.int64).reshape(len(votes), rules)
    return (at == 0).astype(float), (at == 1).astype(float)


def accuracies(patterns: dict[tuple, int], rules: int, steps: int = 2000) -> Kinds:
    """How often each rule votes bad on good documents and on each kind of bad ones, by expectation-maximisation.

    patterns: votes -> number of documents; there are at most 3 to the power of the rules, whatever the corpus' size. It begins with one kind of bad
    documents, in which every rule has some part. Rules that still agree on bad votes within a class more than chance allows
    reveal a further kind, until no two do. Nothing bounds the chances: a rule that fires on good documents on its own loses its weight. No rows: the prior.
    """
    bad, good = _votes(list(patterns), rules)
    n = np.array(list(patterns.values()), float)
    pulls = [np.tile(np.array(x)[:, None], rules) for x in (ON_GOOD, ON_BAD)]  # per class: [bad or good, rule]
    while True:
        prior = np.array([x.sum(axis=0).max() for x in pulls]) * np.where(np.arange(len(pulls)) == 0, 4.0, 1.0)
        kinds = Kinds(prior / prior.sum(), np.stack([x[0] / x.sum(axis=0) for x in pulls]))
        for _ in range(steps if len(n) else 0):
            weight = kinds.joint(bad, good).T * n
            b, g = weight @ bad + np.stack([x[0] for x in pulls]), weight @ good + np.stack([x[1] for x in pulls])
            shares = weight.sum(axis=1) + prior
            last, kinds = kinds, Kinds(shares / shares.sum(), b / (b + g))
            if np.abs(kinds.bad - last.bad).max() < 1e-9:
                break
        if not len(n) or len(pulls) > rules:
            return kinds
        agree = np.zeros((rules, rules))
        for weight in kinds.joint(bad, good).T * n:
            one, both = weight @ bad, (bad * weight[:, None]).T @ bad
            chance = np.outer(one, one) / max(weight.sum(), 1e-300)
            ratio = both * np.log(np.maximum(both, 1e-300) / np.maximum(chance, 1e-300)) - both + chance
            agree = np.maximum(agree, np.where(both > 2 * chance, ratio, 0.0))
        np.fill_diagonal(agree, 0.0)
        if agree.max() <= SURE:
            return kinds
        own = np.array(ON_BAD)[:, None] * np.ones(rules)
        own[:, list(np.unravel_index(agree.argmax(), agree.shape))] = np.array(ON_OWN)[:, None]
        pulls.append(own)


def judged(rows: DataFrame) -> DataFrame:
    """rows (of features()) with quality, the posterior probability that a document is good, from the votes of all rows together."""
    spark, rules = rows.sparkSession, votes()
    names = [f"vote_{r}" for r in rules]
    cast = [c.cast("int").alias(n) for n, c in zip(names, rules.values())]
    counts = {tuple(r[:-1]): r[-1] for r in rows.select(*cast).groupBy(*names).count().collect()}  # 3 to the power of the rules at most
    known = sorted(counts, key=repr)
    quality = accuracies({v: counts[v] for v in known}, len(rules)).posterior(known)
    schema = ", ".join(f"{n} int" for n in names) + ", quality double"
    table = spark.createDataFrame([(*v, float(q)) for v, q in zip(known, quality)], schema)
    voted = rows.select("*", *cast)
    same = [voted[n].eqNullSafe(table[n]) for n in names]
    return voted.join(F.broadcast(table), same).select(*[voted[c] for c in rows.columns], "quality")


def scored_documents(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """features() with base_failed, quality and kept: not base_failed and a quality of at least `least`.

    Null and empty texts have no words and fail the base. Rows are judged one by one, so repeated rows get equal
    results; extra columns are not read; an empty table gives no rows.
    """
    rows = written(features(docs))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged(rows).withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("quality") >= least))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"]
    return scored_documents(read(spark, sf_dir, "documents")).select(*names)
