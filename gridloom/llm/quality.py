"""Quality rules as weak supervision: each rule votes good, bad or abstains; expectation-maximisation
estimates how often each is right on either class, and the posterior chance of quality decides.

All work on rows is native Spark expressions. What reaches the driver is one count per vote pattern
(3 ** rules rows at most, whatever the input), over which the EM runs in plain arithmetic.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import checkpoint, stored, whole_row, words

#: Frequent function words of four languages, which running prose has and lists lack.
FUNCTION_WORDS = (
    "the of and to in is a that it for was on are with by "
    "de la le les et un une du des en que qui dans pour est "
    "el los las y se por con una para del "
    "der die das und von zu den mit auf für ist ein eine nicht"
).split()
RULES = ("symbols", "capitals", "repetition", "lines", "length", "function_words", "sentence_ends", "word_length")
START_GOOD, START_BAD = 0.98, 0.4


@dataclass(frozen=True)
class LabelModel:
    """Prior of good, and for each rule P(votes good | good, it votes) and P(votes bad | bad, it votes)."""

    prior: float
    right_good: tuple[float, ...]
    right_bad: tuple[float, ...]


def _repeat_words(w: Column) -> Column:
    """Words inside 3-word windows whose text occurs twice or more.

    Windows are hashed to 64 bits and sorted with their places, so equal ones are neighbours;
    time is n log n for a text of n words.
    """
    n = F.size(w)
    windows = F.transform(F.slice(w, 1, n - 2), lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p")))
    s = F.sort_array(windows)

    def cover(s: Column) -> Column:
        twin = lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])
        places = F.sort_array(F.transform(F.filter(s, lambda x, i: F.coalesce(twin(x, i), F.lit(False))), lambda x: x["p"]))
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("total"))
        step = lambda a, p: F.struct(p.alias("last"), (a["total"] + F.least(F.lit(3), p - a["last"])).alias("total"))
        return F.aggregate(places, start, step, lambda a: a["total"])

    # transform over a one-element array names the sorted array once, so it is computed once.
    return F.when(n >= 4, F.element_at(F.transform(F.array(s), cover), 1)).otherwise(F.lit(0).cast("long"))


def features(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns and a struct column ``_q`` with the figures of each text; null counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(*[docs[c] for c in keep or []], text.alias("_text"), words(F.col(text_col)).alias("_w"))
    long = lambda c: c.cast("long")
    lines = F.filter(F.split("_text", "\n"), lambda x: F.rlike(x, F.lit("[^\\x20\\x09-\\x0D]")))
    without = lambda pattern: F.length(F.regexp_replace("_text", F.lit(pattern), F.lit("")))
    joined = F.array_join("_w", "")
    wanted = F.array(*[F.lit(x) for x in FUNCTION_WORDS])
    ends = F.filter("_w", lambda x: F.endswith(x, F.lit(".")) | F.endswith(x, F.lit("?")) | F.endswith(x, F.lit("!")))
    figures = F.struct(
        long(F.size("_w")).alias("n_words"),
        long(F.length(joined)).alias("word_chars"),
        long(F.length("_text") - without("[#*$%&|<>]+")).alias("n_symbols"),
        F.element_at(F.transform(F.array(lines), lambda x: long(F.size(x) - F.size(F.array_distinct(x)))), 1).alias("n_dup_lines"),
        _repeat_words(F.col("_w")).alias("n_repeat_words"),
        long(F.length("_text") - without("\n+") + 1).alias("n_lines"),
        long(F.length("_text") - without("[A-Z]+")).alias("n_upper"),
        long(F.size(F.filter("_w", lambda x: F.array_contains(wanted, x)))).alias("n_function"),
        long(F.size(ends)).alias("n_ends"),
    )
    # Not deterministic by form (though always true), so that no filter on the figures is pushed
    # below this projection, where each of its references would compute them anew.
    once = F.when(F.monotonically_increasing_id() >= 0, figures)
    return base.select(*[F.col(c) for c in keep or []], once.alias("_q"))


def votes(q: Column) -> list[Column]:
    """One column a rule, in the order of RULES: 1 good, -1 bad, 0 abstains."""
    share = lambda a: q[a] / F.greatest(q["n_words"], F.lit(1))
    upper, length = q["n_upper"] / F.greatest(q["word_chars"], F.lit(1)), q["word_chars"] / F.greatest(q["n_words"], F.lit(1))

    def rule(bad: Column, good: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    return [
        rule(share("n_symbols") > 0.3, share("n_symbols") < 0.05),
        rule(upper > 0.5, upper < 0.2),
        rule(share("n_repeat_words") > 0.3, share("n_repeat_words") < 0.15),
        rule(q["n_dup_lines"] * 4 > q["n_lines"], (q["n_dup_lines"] == 0) & (q["n_lines"] > 1)),
        rule(q["n_words"] < 20, q["n_words"] >= 60),
        rule((share("n_function") < 0.02) & (q["n_words"] >= 20), share("n_function") > 0.08),
        rule((share("n_ends") > 0.4) | ((q["n_ends"] == 0) & (q["n_words"] >= 60)), share("n_ends").between(0.02, 0.25)),
        rule((length < 2.5) | (length > 14), length.between(3, 11)),
    ]


def base_failed(q: Column) -> Column:
    """Too short, or more than half of the words repeat."""
    return (q["n_words"] < 50) | (100 * q["n_repeat_words"] > 50 * q["n_words"])


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 100, prior_share: float = 0.05) -> LabelModel:
    """EM over counts of vote patterns.

    Accuracies start at START_GOOD and START_BAD: a rule rarely speaks against a good text, but each
    sees only some kinds of bad ones. Pseudo-votes worth ``prior_share`` of all texts (10 at least)
    hold them there, so a corpus without bad texts does not split its good ones. No patterns give the start.
    """
    k = len(patterns[0][0]) if patterns else len(RULES)
    total = sum(c for _, c in patterns)
    pseudo = max(10.0, prior_share * total)
    prior, good, bad = 0.8, [START_GOOD] * k, [START_BAD] * k
    for _ in range(rounds):
        model = LabelModel(prior, tuple(good), tuple(bad))
        n_good = 0.0
        hits = [[START_GOOD * pseudo, START_BAD * pseudo] for _ in range(k)]
        seen = [[pseudo, pseudo] for _ in range(k)]
        for vote, count in patterns:
            p = 1 / (1 + math.exp(-max(-500.0, min(500.0, log_odds(model, vote)))))
            n_good += p * count
            for j, v in enumerate(vote):
                if v:
                    seen[j][0] += p * count
                    seen[j][1] += (1 - p) * count
                    hits[j][0 if v > 0 else 1] += (p if v > 0 else 1 - p) * count
        new = (n_good + 8) / (total + 10)
        moved = abs(new - prior)
        prior = min(0.99, max(0.01, new))
        good = [min(0.999, h[0] / s[0]) for h, s in zip(hits, seen, strict=True)]
        bad = [min(0.999, h[1] / s[1]) for h, s in zip(hits, seen, strict=True)]
        if moved < 1e-9:
            break
    return LabelModel(prior, tuple(good), tuple(bad))


def log_odds(model: LabelModel, vote: tuple[int, ...]) -> float:
    """Of good against bad, given the votes."""
    x = math.log(model.prior / (1 - model.prior))
    for v, g, b in zip(vote, model.right_good, model.right_bad, strict=True):
        if v > 0:
            x += math.log(g / (1 - b))
        elif v < 0:
            x += math.log((1 - g) / b)
    return x


def posterior(model: LabelModel, vote: list[Column]) -> Column:
    """The posterior chance of good as an expression of vote columns."""
    x = F.lit(math.log(model.prior / (1 - model.prior)))
    for v, g, b in zip(vote, model.right_good, model.right_bad, strict=True):
        x = x + F.when(v > 0, math.log(g / (1 - b))).when(v < 0, math.log((1 - g) / b)).otherwise(0.0)
    return 1 / (1 + F.exp(-x))


def learn(figures: DataFrame) -> LabelModel:
    """Fit on the vote patterns of all rows of ``features``."""
    return fit(counted(figures.select(F.array(*votes(F.col("_q"))))))


def counted(patterns: DataFrame) -> list[tuple[tuple[int, ...], int]]:
    """Vote patterns of a one-column table and their counts; 3 ** rules rows at most."""
    return sorted((tuple(r["v"]), r["count"]) for r in patterns.toDF("v").groupBy("v").count().collect())


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Figures, verdict and posterior of every row.

    Null, empty and blank texts have zeros and fail the base rule. Repeated rows each give a row with the
    same verdict; other columns are left aside; no rows give no rows. The figures are
    checkpointed (a few longs a row), so each text is read once.
    """
    figures = checkpoint(features(docs, text_col, [id_col]))
    q = F.col("_q")
    chance = posterior(learn(figures), votes(q))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    out = figures.select(F.col(id_col), *[q[x].alias(x) for x in names], base_failed(q).alias("base_failed"), chance.alias("quality"))
    return out.select(id_col, *names, "base_failed", (~F.col("base_failed") & (F.col("quality") >= 0.5)).alias("kept"), "quality")


def keep_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with their columns, whatever their names.

    The rows that the base rule leaves and the votes on all are written once to the shared folder, so the figures are computed
    once and nothing is shuffled. Null, empty and blank texts go; repeated rows are judged alike; no rows give no rows.
    """
    q = F.col("_q")
    rows = docs.select(whole_row(docs).alias("_row"), docs[text_col].alias("_given"))
    figures = features(rows, "_given", ["_row"])
    marked = stored(figures.select(F.when(~base_failed(q), F.col("_row")).alias("_row"), F.array(*votes(q)).alias("_v")))
    model = fit(counted(marked.select("_v")))
    chance = posterior(model, [F.get("_v", F.lit(k)) for k in range(len(RULES))])
    return marked.where(F.col("_row").isNotNull() & (chance >= 0.5)).select("_row.*")
