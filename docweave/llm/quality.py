"""Operator 8: quality classifier.

Method: sparse rule ensemble.  Boosted trees are grown on statistics of the text;
every path from a root to a node is a conjunctive rule; a lasso-penalised logistic
regression weighs the rules, most of them with zero; the rest are compiled into
one Spark column expression over the statistics.

The fit uses at most `SAMPLE` labelled rows (those with the smallest hash of their
id); scoring covers every row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import WordHasher, buffers, read_table, space_words, utf8
from .boosting import Trees

#: Most labelled rows that the fit reads.
SAMPLE = 20_000
FOLDS = 5
THRESHOLD = 0.3

FEATURES = "log_bytes words word_length upper digits marks symbols pipes bangs non_ascii lines line_length distinct repeated_lines same_next top_word caps_words ends".split()


def _flags(codes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(codes)] = True
    return t


UPPER = _flags(range(65, 91))
LETTER = _flags([*range(65, 91), *range(97, 123)])
DIGITS = _flags(range(48, 58))
MARKS = _flags(b".,;:?!'\"()-")
SYMBOLS = _flags(b"#$%&*+/<=>@[\\]^_`{}~|")
HIGH = _flags(range(128, 256))
ENDS = _flags(b".?!")


def per_text(flags: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags)])
    return (sums[cuts[1:]] - sums[cuts[:-1]]).astype(float)


def statistics(texts: list[bytes], hasher: WordHasher, line_hasher: WordHasher) -> np.ndarray:
    """A row of FEATURES for each text (UTF-8)."""
    h, text, start, end, first = hasher.words(texts)
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    lens = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    cuts = np.concatenate([[0], np.cumsum(lens + 1)])
    n, size = len(texts), np.maximum(lens, 1)
    words = np.diff(first).astype(float)
    many = np.maximum(words, 1)
    count = lambda flags: per_text(flags[buf], cuts)
    letters = np.maximum(count(LETTER), 1)

    def groups(values, owner):
        """Of each text: how many different values, and how often the most frequent stands."""
        if not len(values):
            return np.zeros(n), np.zeros(n)
        order = np.lexsort((values, owner))
        v, o = values[order], owner[order]
        new = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (o[1:] != o[:-1])]))
        runs = np.diff(np.append(new, len(v)))
        top = np.zeros(n)
        np.maximum.at(top, o[new], runs)
        return np.bincount(o[new], minlength=n).astype(float), top

    kinds, top = groups(h, text)
    lh, lt, _, _, lf = line_hasher.words(texts)
    lines = np.diff(lf).astype(float)
    line_kinds, _ = groups(lh, lt)
    pairs = (h[1:] == h[:-1]) & (text[1:] == text[:-1]) if len(h) else np.zeros(0, bool)
    same = np.bincount(text[1:][pairs], minlength=n).astype(float) if len(h) else np.zeros(n)
    ups = np.concatenate([[0], np.cumsum(UPPER[buf])])
    lets = np.concatenate([[0], np.cumsum(LETTER[buf])])
    in_word = lets[end] - lets[start]
    caps = np.bincount(text[(in_word >= 2) & (ups[end] - ups[start] == in_word)], minlength=n).astype(float)
    columns = [np.log1p(lens), words, lens / many, count(UPPER) / letters, count(DIGITS) / size, count(MARKS) / size, count(SYMBOLS) / size, count(_flags(b"|")) / many, count(_flags(b"!")) / many, count(HIGH) / size, lines, lens / np.maximum(lines, 1), kinds / many, 1 - line_kinds / np.maximum(lines, 1), same / many, top / many, caps / many, count(ENDS) / many]
    return np.round(np.stack(columns, 1), 9)


def hashers() -> tuple[WordHasher, WordHasher]:
    line = np.ones(256, bool)
    line[10] = False
    return WordHasher(space_words(), lower=True), WordHasher(line)


def with_statistics(docs: DataFrame, name: str) -> DataFrame:
    """docs with a struct `name` of the FEATURES of its text."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{name}` struct<{','.join(f'{f}:double' for f in FEATURES)}>"])
    at = docs.columns.index("text")
    both = hashers()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = utf8(batch.column(at))
            for i, j in buffers(texts):
                x = statistics(texts[i:j], *both)
                found = pa.StructArray.from_arrays([pa.array(x[:, k]) for k in range(len(FEATURES))], names=FEATURES)
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, found], names=[*part.schema.names, name])

    return docs.mapInArrow(run, schema)


# ------------------------------------------------------------- rules

Rule = tuple[tuple[int, bool, float], ...]  # (feature, above, cut), all of which must hold


def rules_of(trees: Trees) -> list[Rule]:
    """Different paths from the roots to all nodes but the roots."""
    found: dict[Rule, None] = {}
    for features, cuts in zip(trees.features, trees.cuts, strict=True):
        paths: dict[int, dict] = {0: {}}
        for i in range(len(features)):
            if i not in paths or not np.isfinite(cuts[i]):
                continue
            for above in (False, True):
                path = dict(paths[i])
                key, cut = (int(features[i]), above), float(cuts[i])
                path[key] = max(path.get(key, cut), cut) if above else min(path.get(key, cut), cut)
                paths[2 * i + 1 + above] = path
                found[tuple(sorted((f, a, c) for (f, a), c in path.items()))] = None
    return list(found)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, above, cut in rule:
        out &= x[:, f] > cut if above else x[:, f] <= cut
    return out


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 200) -> tuple[float, np.ndarray]:
    """Bias and weights of an L1-penalised logistic regression, by accelerated proximal gradients."""
    n = len(y)
    z = np.concatenate([np.ones((n, 1), np.float32), z.astype(np.float32)], 1)
    v = np.ones(z.shape[1], np.float32)
    for _ in range(20):  # the largest eigenvalue, for the step length
        v = z.T @ (z @ v)
        v /= np.linalg.norm(v)
    step = 1 / (0.25 * float(v @ (z.T @ (z @ v))) / n * 1.05)
    w = np.zeros(z.shape[1])
    ahead, momentum = w, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ ahead.astype(np.float32), -30, 30)))
        new = ahead - step * (z.T @ (p - y).astype(np.float32)) / n
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead, w, momentum = new + (momentum - 1) / after * (new - w), new, after
    return float(w[0]), w[1:]


class RuleModel:
    """bias and weighted rules; `column` compiles them."""

    def __init__(self, bias: float, rules: list[tuple[float, Rule]]):
        self.bias, self.rules = bias, rules

    def column(self, name: str) -> Column:
        total: Column = F.lit(self.bias)
        for weight, rule in self.rules:
            both: Column | None = None
            for f, above, cut in rule:
                x = F.col(f"`{name}`")[FEATURES[f]]
                test = x > F.lit(cut) if above else x <= F.lit(cut)
                both = test if both is None else both & test
            total = total + F.when(both, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for weight, rule in self.rules:
            total += weight * holds(rule, x)
        return 1 / (1 + np.exp(-total))


def fit_rules(x: np.ndarray, y: np.ndarray, penalty: float = 5e-4) -> RuleModel:
    """A model of x (rows of FEATURES) and y (0 or 1).  Without rows every score is
    0.5; with one class only, the share of its label, smoothed."""
    share = (y.sum() + 1) / (len(y) + 2)
    if len(np.unique(y)) < 2:
        return RuleModel(float(np.log(share / (1 - share))), [])
    rules = rules_of(Trees(3, 0.3).fit(x, y.astype(float), rounds=25))
    bias, weights = lasso(np.stack([holds(r, x) for r in rules], 1), y.astype(float), penalty)
    return RuleModel(bias, [(float(w), r) for w, r in zip(weights, rules, strict=True) if abs(w) > 1e-6])


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> RuleModel:
    """Learns from labelled rows outside fold 0; null ids or labels teach nothing,
    an id with several labels teaches the largest."""
    known = labels.select(F.col("doc_id").alias("label_id"), F.col("quality").cast("int").alias("label")).where("label_id is not null and label in (0, 1)").where(fold(F.col("label_id")) != 0)
    chosen = known.groupBy("label_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("label_id"), "label_id").limit(sample)
    # At most `sample` rows of two numbers each are broadcast, and their statistics collected.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "label")
    found = with_statistics(rows, "s").select("doc_id", "label", "s.*").orderBy("doc_id", *FEATURES).limit(sample).toPandas()
    return fit_rules(found[FEATURES].to_numpy(float), found["label"].to_numpy(int))


def score_quality(docs: DataFrame, model: RuleModel, score: str = "score") -> DataFrame:
    """docs with the score of each row's text.

    Null and empty texts are scored as empty; repeated rows and null ids stay; a
    column of docs named like the score is replaced; no rows give no rows."""
    name = "_statistics"
    while name in docs.columns:
        name += "_"
    return with_statistics(docs, name).withColumn(score, model.column(name)).drop(name)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of docs that the classifier does not reject, with their columns."""
    model = train(docs, labels)
    name = "_quality"
    while name in docs.columns:
        name += "_"
    return score_quality(docs, model, name).where(F.col(name) >= THRESHOLD).select(*[f"`{c}`" for c in docs.columns])


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, read_table(spark, sf_dir, "labels"))
    scored = score_quality(docs, model)
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
