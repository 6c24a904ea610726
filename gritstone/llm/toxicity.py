"""Toxicity by a weighted finite-state pattern grammar.

Words are read by a cascade of small transducers. The lexicon maps a word to a class (insult,
threat, target, negation, report) and a weight; insult words and stems and their weights are
learned from labelled rows. Then, clause by clause, the negation transducer takes weight from
what follows a negation, the report transducer from what a report verb introduces, and the match
transducer adds weight where an insult or threat meets a target. A document is described by its
matched clauses only; a logistic regression on these, fitted to the same labelled rows, scores it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Labelled rows that are learned from at most (those whose doc_id hashes lowest), and entries of the learned lexicon.
TRAIN_ROWS, LEXICON = 20_000, 4_000
STEMS = (4, 5, 6)
_WORD = re.compile(r"[^\W\d_]+")
#: Fixed word lists of the grammar, in the languages of the corpus.
CLASSES = {
    "threat": "kill hurt destroy attack burn shoot beat töten verletzen zerstören tuer frapper détruire matar golpear destruir",
    "target": "you your yours u he she they him her them these those du dich dein ihr euch tu te toi vous ton votre tú tu usted ustedes ellos ellas",
    "negation": "not no never nor neither isn't aren't don't nicht kein keine nie niemals ne pas jamais aucun nunca ningún tampoco",
    "report": "said says say wrote writes called calls quoted claimed sagte sagt schrieb nannte dit disait écrit appelé dijo dice escribió llamó",
}
_FIXED = {w: name for name, words in CLASSES.items() for w in words.split()}
#: A listed contraction, a run of letters, or a mark that ends a clause (not inside a number).
_PART = re.compile("|".join([*(rf"(?<![^\W\d_]){re.escape(w)}(?![^\W\d_])" for w in sorted(_FIXED) if not w.isalpha()), _WORD.pattern, r"[.!?;:,|](?!\d)"]))
_END = frozenset(".!?;:,|")


class Transducer:
    """arcs: (state, class) -> (next state, factor, bonus); a missing arc keeps the weight and goes to `rest`."""

    def __init__(self, arcs: dict[tuple[int, str], tuple[int, float, float]], rest: dict[int, int]) -> None:
        self.arcs, self.rest = arcs, rest

    def run(self, clause: list[tuple[str, float]]) -> list[tuple[str, float]]:
        state, out = 0, []
        for name, weight in clause:
            nxt, factor, bonus = self.arcs.get((state, name), (self.rest.get(state, 0), 1.0, 0.0))
            out.append((name, weight * factor + bonus))
            state = nxt
        return out


_HIT = ("insult", "threat")
#: After a negation three words are in its scope (states 1 to 3).
NEGATE = Transducer({**{(s, "negation"): (1, 1.0, 0.0) for s in range(4)}, **{(s, h): (s % 3 + 1 if s < 3 else 0, 0.2, 0.0) for s in (1, 2, 3) for h in _HIT}}, {1: 2, 2: 3})
#: A report verb holds to the end of its clause.
REPORT = Transducer({(0, "report"): (1, 1.0, 0.0), **{(1, h): (1, 0.4, 0.0) for h in _HIT}}, {1: 1})
#: A target before a hit, up to four words away, or right after it.
MATCH = Transducer(
    {**{(s, "target"): (1, 1.0, 0.0) for s in range(5)}, **{(s, h): (5, 1.0, 0.5) for s in (1, 2, 3, 4) for h in _HIT}, **{(0, h): (5, 1.0, 0.0) for h in _HIT}, (5, "target"): (1, 1.0, 0.5)},
    {1: 2, 2: 3, 3: 4, 5: 0},
)
CASCADE = (NEGATE, REPORT, MATCH)


_BORDER, _PLAIN = ("end", 0.0), ("", 0.0)


class Grammar:
    def __init__(self, lexicon: dict[str, float]) -> None:
        self.lexicon = lexicon
        self.cache: dict[str, list[tuple[str, float]]] = {}

    def word(self, w: str) -> tuple[str, float]:
        """Class and weight of a lower-case word; a stem counts if the whole word isn't listed."""
        weight = self.lexicon.get(w) or max((self.lexicon.get(w[:k] + "*", 0.0) for k in STEMS if len(w) >= k), default=0.0)
        if weight:
            return "insult", weight
        name = _FIXED.get(w)
        return (name, 1.0 if name == "threat" else 0.0) if name else _PLAIN

    def token(self, token: str) -> list[tuple[str, float]]:
        """All words of a lower-case token and the ends of clauses between and after them; a token without words counts as a plain one."""
        out = [_BORDER if part in _END else self.word(part) for part in _PART.findall(token)]
        return out if any(x is not _BORDER for x in out) else [_PLAIN, *out]

    def features(self, text: str) -> list[float]:
        cache, tokens = self.cache, text.lower().split()
        if len(cache) > 300_000:
            cache.clear()
        for t in set(tokens):
            if t not in cache:
                cache[t] = self.token(t)
        told = [x for t in tokens for x in cache[t]]
        told.append(_BORDER)
        sums, best, directed, threats, words = 0.0, 0.0, 0.0, 0.0, len(tokens)
        clauses, start, hit = 0, 0, False
        for i, (kind, _) in enumerate(told):
            if not kind:
                continue
            if kind != "end":
                hit = hit or kind in _HIT
                continue
            if hit:
                clause = told[start:i]
                for step in CASCADE:
                    clause = step.run(clause)
                weight = sum(w for name, w in clause)
                clauses, sums, best = clauses + 1, sums + weight, max(best, weight)
                directed += any(name == "target" for name, _ in clause)
                threats += sum(name == "threat" for name, _ in clause)
            start, hit = i + 1, False
        return [1.0, math.log1p(sums), best, math.log1p(clauses), math.log1p(directed), math.log1p(threats), sums / math.sqrt(words + 10), math.log1p(words) / 5]


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        entries, toxic = [], []
        for text, label in zip(batch.column("text"), batch.column("toxic"), strict=True):
            words = set(_WORD.findall((text.as_py() or "").lower()))
            own = words | {w[:k] + "*" for w in words for k in STEMS if len(w) >= k}
            entries += own
            toxic += [int(label.as_py())] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(entries, pa.string()), pa.array(toxic, pa.int32())], ["entry", "toxic"])


def learn(labelled: DataFrame) -> tuple[dict[str, float], np.ndarray]:
    """Lexicon and regression weights from a bounded labelled(text, toxic)."""
    total = labelled.agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).first()
    n, t = total.n or 0, total.t or 0
    if not n or not t or t == n:
        bias = np.zeros(8)
        bias[0] = -3.0 if not t else 3.0
        return {}, bias
    base = t / n
    counts = labelled.mapInArrow(_candidates, "entry string, toxic int").groupBy("entry").agg(F.count("*").alias("n"), F.sum("toxic").alias("t"))
    z = (F.col("t") - F.col("n") * base) / F.sqrt(F.col("n") * base * (1 - base) + 1)
    lift = F.log((F.col("t") + 0.5 * base) / (F.col("n") - F.col("t") + 0.5 * (1 - base)) * ((1 - base) / base))
    strong = counts.filter("t >= 3 and t >= 0.8 * n").select("entry", z.alias("z"), lift.alias("lift")).filter("z >= 4.5").orderBy(F.desc("z"), "entry").limit(LEXICON).collect()
    lexicon = {r.entry: min(3.0, r.lift / 2) for r in strong}
    rows = labelled.mapInArrow(_describe(lexicon), "toxic int, features array<double>").collect()  # at most TRAIN_ROWS short rows
    x, y = np.array([r.features for r in rows]), np.array([r.toxic for r in rows], float)
    w = np.zeros(x.shape[1])
    for _ in range(40):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.3 * np.eye(len(w))
        w -= np.linalg.solve(hessian, x.T @ (p - y) + 0.3 * w)
    return lexicon, w


def _describe(lexicon: dict[str, float]):  # noqa: ANN202
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(lexicon)
        for batch in batches:
            f = [grammar.features(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("toxic").cast(pa.int32()), pa.array(f, pa.list_(pa.float64()))], ["toxic", "features"])

    return describe


def _score(lexicon: dict[str, float], weights: np.ndarray):  # noqa: ANN202
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(lexicon)
        for batch in batches:
            f = np.array([grammar.features(t.as_py() or "") for t in batch.column("text")]).reshape(batch.num_rows, len(weights))
            p = 1 / (1 + np.exp(-np.clip(f @ weights, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array(np.expm1(f[:, 3]).round().astype(np.int32))], ["doc_id", "score", "n_clauses"])

    return score


def toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted and n_clauses (all matched ones) of each row of docs(doc_id, text).

    Learned from at most train_rows rows of labels(doc_id, toxic) with crc32(doc_id) mod 5 not 0
    and a label of 0 or 1. Null and empty texts match no clause and get the score of such texts;
    rows with a null doc_id are scored and not held out; repeated rows get a row each; a text of any
    length is read whole; an empty table gives an empty table. Without
    usable labels every score is under a half. Other columns are never read.
    """
    usable = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)").filter(~held_out())
    few = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    labelled = texts.join(F.broadcast(few), "doc_id").select("text", "toxic")  # few is bounded by train_rows
    lexicon, weights = learn(labelled)
    told = texts.mapInArrow(_score(lexicon, weights), "doc_id bigint, score double, n_clauses int")
    return told.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_clauses")


def op7_grammar_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
