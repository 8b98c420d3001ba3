"""Toxicity by a weighted finite-state pattern grammar over clauses.

A text is read as classes of words: insult, threat, target, negation, report verb, quotation mark, end of
a clause or sentence, other. Five small transducers read the classes side by side; their composition, built
arc by arc as it is needed, writes what an insult or threat is: plain, aimed at a target near it, inside
the scope of a negation, or reported speech (after a report verb, or quoted after one). Each match carries
the weight of its word, matches add up by kind and clause, and a logistic model turns the sums of a
document into a score. A word that stands alone in the lexicon does not decide; its clause does.

Word lists of negations, targets, report verbs and threats are given. Insults are learned: forms and stems
(beginnings of 4 to 7 letters) of words weigh the logarithm of how much likelier they are in toxic texts,
less ERRORS standard errors, and a word takes the greatest weight on its path. They come from at most `sample` labelled rows, taken by
a hash of their doc_id, and one row of each group of near copies (an equal least hash of the two-word
shingles in one of COPY_KEYS orders), so no copied text can fill the lexicon. Half of those rows give the lexicon, the other half the model.

NULL and empty texts have no matches and score like any text without. Labels that are NULL are left out; of
several labels of a doc_id the greatest holds. Without toxic labels to learn from, every score is the share
of toxic labels (0 without labels). Whole texts are scored, a row per document.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import rows_of, slices
from sievework.session import cut

SAMPLE = 20_000
STEMS = (4, 5, 6, 7)
LEAST_WEIGHT, ERRORS, LEAST_TEXTS = 0.25, 2.5, 3
COPY_KEYS = 4
THRESHOLD = 0.3
SCOPE, REACH = 3, 4
#: Words whose weights a task remembers.
KNOWN = 100_000

NEGATIONS = frozenset("not no never neither nor isn't aren't wasn't don't doesn't nicht kein keine nie niemals ne pas jamais aucun nunca tampoco".split())
TARGETS = frozenset("you your yours yourself he she they them him du dich dein deine ihr euch tu toi vous votre tú usted ustedes".split())
REPORTS = frozenset("said says say told called calls wrote writes quoted claimed reported sagte sagt nannte schrieb dit disait appelé écrit dijo dice llamó escribió".split())
THREATS = frozenset("kill hurt destroy punch stab shoot strangle töten umbringen schlagen verletzen tuer frapper détruire matar golpear destruir".split())

TOKENS = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[.!?\n]+|[,;:]|[\"“”«»„]")
WORDS = re.compile(r"[^\W\d_]+")
INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, PAUSE, STOP, OTHER = range(9)
KINDS = ("plain", "aimed", "negated", "reported")
FEATURES = [f"{what}_{kind}" for what in ("insult", "threat") for kind in KINDS] + ["clauses", "density", "strongest"]


def negation_arc(left: int, symbol: int) -> int:
    """Words for which a negation still holds."""
    return SCOPE if symbol == NEGATION else 0 if symbol in (PAUSE, STOP) else max(left - 1, 0)


def target_arc(left: int, symbol: int) -> int:
    """Words for which a target is still near."""
    return REACH if symbol == TARGET else 0 if symbol == STOP else max(left - 1, 0)


def report_arc(state: int, symbol: int) -> int:
    """0 direct, 1 after a report verb until the sentence ends, 2 inside its quotation."""
    if symbol == REPORT:
        return max(state, 1)
    if symbol == QUOTE:
        return {0: 0, 1: 2, 2: 0}[state]
    return 0 if symbol == STOP and state == 1 else state


def match_arc(left: int, symbol: int) -> int:
    """Words for which an insult or threat can still be aimed by a target after it."""
    return REACH if symbol in (INSULT, THREAT) else 0 if symbol in (STOP, TARGET) else max(left - 1, 0)


class Grammar:
    """The composition: one state of each transducer; an arc gives the next state and the kind of match."""

    def __init__(self) -> None:
        self.arcs: dict[tuple[tuple[int, int, int, int], int], tuple[tuple[int, int, int, int], int | None, bool]] = {}

    def arc(self, state: tuple[int, int, int, int], symbol: int):
        found = self.arcs.get((state, symbol))
        if found is None:
            negation, target, report, match = state
            after = (negation_arc(negation, symbol), target_arc(target, symbol), report_arc(report, symbol), match_arc(match, symbol))
            kind = None
            if symbol in (INSULT, THREAT):
                kind = 3 if report else 2 if negation else 1 if target else 0
            found = self.arcs[state, symbol] = (after, kind, symbol == TARGET and match > 0 and not report and not negation)
        return found


@dataclass
class Scorer:
    """Lexicon and model; `features` and `scores` read whole texts."""

    lexicon: dict[str, float] = field(default_factory=dict)
    bias: float = -30.0
    weights: list[float] = field(default_factory=lambda: [0.0] * len(FEATURES))

    def __post_init__(self) -> None:
        self.grammar, self.known = Grammar(), {}

    def __reduce__(self):
        return Scorer, (self.lexicon, self.bias, self.weights)

    def weight(self, word: str) -> float:
        """The greatest weight among the word and its stems; 0 if it is on no path."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) > KNOWN:
                self.known.clear()
            look = self.lexicon.get
            found = self.known[word] = max(look("=" + word, 0.0), *(look(word[:n], 0.0) for n in STEMS if len(word) >= n), 0.0)
        return found

    def symbol(self, token: str) -> int:
        first = token[0]
        if first in ".!?\n":
            return STOP
        if first in ",;:":
            return PAUSE
        if first in "\"“”«»„":
            return QUOTE
        return (
            NEGATION if token in NEGATIONS else TARGET if token in TARGETS else REPORT if token in REPORTS
            else THREAT if token in THREATS else INSULT if self.weight(token) else OTHER
        )

    def features(self, text: str) -> list[float]:
        lowered = text.lower()
        words = WORDS.findall(lowered)
        vocabulary = set(words)
        out = [0.0] * len(FEATURES)
        if not any(w in THREATS or self.weight(w) for w in vocabulary):
            return out
        sums, clauses, strongest, now = [0.0] * (2 * len(KINDS)), 0, 0.0, 0.0
        state, last = (0, 0, 0, 0), None
        for token in TOKENS.findall(lowered):
            symbol = self.symbol(token)
            state, kind, aims = self.grammar.arc(state, symbol)
            if kind is not None:
                weight = 1.0 if symbol == THREAT else self.weight(token)
                last = (kind + len(KINDS) * (symbol == THREAT), weight)
                sums[last[0]] += weight
                now += weight if kind < 2 else 0.0
            elif aims and last and last[0] % len(KINDS) == 0:
                # A target after the match: it was aimed after all.
                sums[last[0]] -= last[1]
                sums[last[0] + 1] += last[1]
                last = None
            elif symbol in (PAUSE, STOP) and now:
                clauses, strongest, now = clauses + 1, max(strongest, now), 0.0
        clauses, strongest = clauses + bool(now), max(strongest, now)
        out[: len(sums)] = [math.log1p(max(s, 0.0)) for s in sums]
        direct = sum(s for i, s in enumerate(sums) if i % len(KINDS) < 2)
        out[len(sums) :] = [math.log1p(clauses), math.log1p(max(1000.0 * direct / max(len(words), 1), 0.0)), math.log1p(strongest)]
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        x = np.array([self.features(t) for t in texts]).reshape(len(texts), len(FEATURES))
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.weights) + self.bias, -30, 30)))


def score(text: Column, scorer: Scorer) -> Column:
    """The score of a text column."""

    @F.arrow_udf("double")
    def scores(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts.fill_null("")], ["text"])
        return pa.array(np.concatenate([np.zeros(0), *[scorer.scores(part.column(0).to_pylist()) for part in slices(batch, "text")]]), pa.float64())

    return scores(text.cast("string"))


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are never learned from. A NULL doc_id has no labels."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """text, toxic, half: at most `sample` labelled rows that are not held out, near copies once."""
    known = (
        rows_of(labels, doc_id=id_col, toxic=labels["toxic"].cast("int")).where("doc_id is not null and toxic is not null")
        .where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    drawn = cut(known.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(sample).drop("h"))
    texts = rows_of(docs, doc_id=id_col, text=F.coalesce(docs[text_col].cast("string"), F.lit("")))
    rows = texts.join(F.broadcast(drawn) if sample <= 1_000_000 else drawn, "doc_id").withColumn("words", F.split(F.lower("text"), r"\s+"))
    pairs = F.transform(F.zip_with("words", F.slice("words", 2, 1 << 30), lambda a, b: F.xxhash64(a, b)), lambda h: F.coalesce(h, F.lit(0)))
    keys = {f"copy{k}": _least_hash(k) for k in range(COPY_KEYS)}
    rows = cut(rows.withColumn("pairs", pairs).withColumns(keys).drop("words", "pairs"))
    # Near copies share most of their shingles, so nearly always one of a few least hashes.
    left = rows.drop("text")
    for key in keys:
        left = left.groupBy(key, "toxic").agg(F.min(F.struct("doc_id", *[k for k in keys if k != key])).alias("r")).select("toxic", key, "r.*")
    once = cut(left.select("doc_id"))
    return rows.select("doc_id", "text", "toxic").join(once, "doc_id").dropDuplicates(["doc_id"]).select(
        "text", "toxic", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == 0).alias("half")
    )


def _least_hash(seed: int) -> Column:
    """The least hash of a row's shingles (column `pairs`) in one of several orders."""
    return F.array_min(F.transform("pairs", lambda h: F.xxhash64(h, F.lit(seed))))


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Weights of word forms ('=word') and stems of at least LEAST_WEIGHT, met in LEAST_TEXTS toxic rows or more. Counts stay in Spark."""
    counts = {bool(r["toxic"]): r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = counts.get(True, 0), counts.get(False, 0)
    if not toxic or not clean:
        return {}
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[\P{L}]+"), lambda w: w != ""))
    stems = [F.expr(f"transform(filter(words, w -> char_length(w) >= {n}), w -> left(w, {n}))") for n in STEMS]
    forms = F.transform("words", lambda w: F.concat(F.lit("="), w))
    entries = rows.select("toxic", words.alias("words")).select("toxic", F.explode(F.array_distinct(F.concat(forms, *stems))).alias("entry"))
    n_toxic, n_clean = F.sum(F.when(F.col("toxic") > 0, 1).otherwise(0)), F.sum(F.when(F.col("toxic") > 0, 0).otherwise(1))
    seen = entries.groupBy("entry").agg(n_toxic.alias("t"), n_clean.alias("c")).where(F.col("t") >= LEAST_TEXTS)
    # The lower end of what the counts allow, so rare words that met toxic texts by chance weigh nothing.
    ratio = F.log((F.col("t") + 0.5) / (toxic + 1.0)) - F.log((F.col("c") + 0.5) / (clean + 1.0))
    weight = ratio - ERRORS * F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    kept = seen.withColumn("w", weight).where(F.col("w") >= LEAST_WEIGHT)
    return {r["entry"]: r["w"] for r in kept.select("entry", "w").collect()}


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Scorer:
    """A scorer from the labelled rows that are not held out."""
    rows = cut(labelled(docs, labels, sample))
    lexicon = learn_lexicon(rows.where("half"))
    share = rows.agg(F.avg("toxic")).first()[0] or 0.0
    scorer = Scorer(lexicon)

    @F.pandas_udf("array<double>")
    def features(texts: pd.Series) -> pd.Series:
        return pd.Series([scorer.features(t) for t in texts])

    other = cut(rows.where("not half").select(F.col("toxic").cast("double").alias("label"), array_to_vector(features("text")).alias("features")))
    if lexicon and other.select("label").distinct().count() == 2:
        model = LogisticRegression(regParam=0.002, maxIter=100, standardization=True).fit(other)
        return Scorer(lexicon, float(model.intercept), [float(w) for w in model.coefficients])
    bounded_share = min(max(share, 1e-9), 1 - 1e-9)
    return Scorer({}, math.log(bounded_share / (1 - bounded_share)) if share else -30.0)
