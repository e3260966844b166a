"""Language ID: averaged hashed subword embeddings under a linear softmax, trained in numpy.

Every run of letters is a word with a boundary on each side; its subwords of 2 to 4 characters are
hashed to buckets, the buckets' vectors are averaged over the text, and a linear softmax follows.
At prediction the vectors and the softmax are multiplied once, so a subword costs one table row.
A temperature and a rejection threshold come from documents kept out of the training.

Defined cases: null, empty and letterless texts get ``und`` with score 0 and are rejected; repeated
rows get equal results; an empty table gives an empty result; with no labelled row, or a single
language, a text with letters gets that only language, or ``und``, with score 1 or 0. Columns other
than the three named ones are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factsheet.llm.common import STEP_CHARS, STEP_ROWS, by_rows, once, picked, unit_hash

UNKNOWN = "und"
BITS = 16
WIDTH = 12
ORDERS = (2, 3, 4)


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return once("letters", lambda: np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))


def codes(texts: list[str]) -> np.ndarray:
    """Code points of joined texts in lower case, boundaries for all but letters; a boundary ends each text."""
    raw = " ".join(texts + [""]).encode("utf-32-le", "surrogatepass")
    points = np.frombuffer(raw, np.uint32)
    return np.where(letters()[points], points, np.uint32(32))


def subwords(points: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the subword at each position, and whether there is one."""
    n = len(points) - order + 1
    if n <= 0:
        return np.zeros(0, np.uint32), np.zeros(0, bool)
    letter = points != 32
    mixed = np.full(n, 2166136261 + order, np.uint32)
    for k in range(order):
        mixed = (mixed ^ points[k : k + n]) * np.uint32(16777619)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(2246822519)
    ok = letter[1 : 1 + n] | letter[:n] if order == 2 else letter[1 : 1 + n].copy()
    for k in range(2, order - 1):
        ok &= letter[k : k + n]
    return mixed >> np.uint32(32 - BITS), ok


def pieces(texts: list[str]):
    """Runs of (text numbers, strings) of about STEP_CHARS; a longer text is cut, its cuts overlapping."""
    number, part, size = [], [], 0
    for i, text in enumerate(texts):
        text = text.lower()
        for at in range(0, max(1, len(text)), STEP_CHARS):
            number.append(i)
            part.append(text[at : at + STEP_CHARS + max(ORDERS) - 1])
            size += len(part[-1])
            if size >= STEP_CHARS:
                yield number, part
                number, part, size = [], [], 0
    if part:
        yield number, part


def scan(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the table's rows over the subwords of each text, and the number of subwords."""
    total, count = np.zeros((len(texts), table.shape[1])), np.zeros(len(texts))
    for number, part in pieces(texts):
        points = codes(part)
        starts = np.concatenate([[0], np.cumsum([len(p) + 1 for p in part])[:-1]])
        for order in ORDERS:
            bucket, ok = subwords(points, order)
            if not len(bucket):
                continue
            at = np.minimum(starts, len(bucket) - 1)
            kept = np.concatenate([[0], np.cumsum(ok)])
            bounds = kept[np.append(starts.clip(max=len(bucket)), len(bucket))]
            rows = np.cumsum(table[bucket[ok]], axis=0, dtype=np.float64)
            rows = np.vstack([np.zeros((1, table.shape[1])), rows])
            np.add.at(total, number, rows[bounds[1:]] - rows[bounds[:-1]])
            np.add.at(count, number, np.diff(bounds))
    return total, count


@dataclass
class LanguageModel:
    """``table``: class scores of each bucket; ``threshold``: the least calibrated score that is accepted."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, texts: list[str]) -> np.ndarray:
        total, count = scan(texts, self.table)
        return total / np.maximum(count, 1)[:, None] + self.bias


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def sparse(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets and shares of each text."""
    found = []
    for text in texts:
        hits = []
        points = codes([text.lower()])
        for order in ORDERS:
            bucket, ok = subwords(points, order)
            hits.append(bucket[ok])
        bucket, n = np.unique(np.concatenate(hits), return_counts=True)
        found.append((bucket, n / max(1, n.sum())))
    return found


def train(texts: list[str], langs: list[str], tuning: list[str], tuning_langs: list[str], epochs: int = 6, rate: float = 40.0, batch: int = 64, false_reject: float = 0.002, seed: int = 7) -> LanguageModel:
    """Stochastic gradient descent on averaged vectors; then temperature and threshold from the tuning texts."""
    names = sorted(set(langs))
    if len(names) < 2:
        return LanguageModel(names, np.zeros((1 << BITS, max(1, len(names))), np.float32), np.zeros(max(1, len(names))))
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (1 << BITS, WIDTH)).astype(np.float32)
    weights = rng.normal(0, 0.5, (WIDTH, len(names)))
    bias = np.zeros(len(names))
    target = np.array([names.index(x) for x in langs])
    rows = sparse(texts)
    # Each language weighs the same, however many documents it has.
    weight = 1 / np.bincount(target, minlength=len(names))[target]
    weight *= len(target) / weight.sum()
    steps, step = epochs * -(-len(rows) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), batch):
            now = order[at : at + batch]
            bucket = np.concatenate([rows[i][0] for i in now])
            share = np.concatenate([rows[i][1] for i in now])
            owner = np.repeat(np.arange(len(now)), [len(rows[i][0]) for i in now])
            inner = vectors[bucket] * share[:, None]
            hidden = np.stack([np.bincount(owner, inner[:, d], len(now)) for d in range(WIDTH)], axis=1)
            wrong = softmax(hidden @ weights + bias)
            wrong[np.arange(len(now)), target[now]] -= 1
            wrong *= weight[now][:, None] / len(now)
            eta = rate * (1 - step / steps)
            back = wrong @ weights.T
            weights -= 0.02 * eta * (hidden.T @ wrong)
            bias -= 0.002 * eta * wrong.sum(axis=0)
            seen, spot = np.unique(bucket, return_inverse=True)
            push = back[owner] * share[:, None]
            vectors[seen] -= eta * np.stack([np.bincount(spot, push[:, d], len(seen)) for d in range(WIDTH)], axis=1).astype(np.float32)
            step += 1
    model = LanguageModel(names, (vectors @ weights).astype(np.float32), bias)
    known = [(t, x) for t, x in zip(tuning, tuning_langs) if x in names]
    if known:
        scores = model.logits([t for t, _ in known])
        truth = np.array([names.index(x) for _, x in known])
        grid = np.geomspace(0.05, 20, 60)
        loss = [-np.log(softmax(scores / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        sure = softmax(scores / model.temperature)
        right = np.sort(sure.max(axis=1)[sure.argmax(axis=1) == truth])
        if len(right):
            model.threshold = float(min(right[int(false_reject * (len(right) - 1))], 0.5))
    return model


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 700, longest: int = 20_000, most_languages: int = 200) -> LanguageModel:
    """Learn from documents outside fold 0; fold 1 calibrates.

    About ``per_language`` documents of each of the ``most_languages`` commonest languages, of at
    most ``longest`` characters, are taken by a hash of the id: the sample's bound for any size.
    """
    rows = picked(docs, (doc_id, "doc_id"), (text, "text"), (lang, "lang")).filter(F.col("lang").isNotNull() & (fold(F.col("doc_id")) != 0))
    rows = rows.filter(F.col("text").isNotNull() & (F.length("text") <= longest))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()
    if not counts:
        return train([], [], [], [])
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, 1.2 * per_language / r["count"]))])
    sample = (
        rows.withColumn("u", unit_hash(F.col("doc_id").cast("string"), F.lit("language")))
        .filter(F.col("u") < share[F.col("lang")])
        .select("lang", "text", (fold(F.col("doc_id")) == 1).alias("tuning"), "u")
        .limit(2 * per_language * len(counts))
        .collect()
    )
    sample.sort(key=lambda r: (r["u"], r["text"]))
    kept = [r for r in sample if any(map(str.isalpha, r["text"]))]
    learn, tune = [r for r in kept if not r["tuning"]], [r for r in kept if r["tuning"]]
    return train([r["text"] for r in learn], [r["lang"] for r in learn], [r["text"] for r in tune], [r["lang"] for r in tune])


def predict(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score, accepted."""
    rows = picked(docs, (doc_id, "doc_id"), (text, "text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def score(batch: pa.RecordBatch):
        texts = [t or "" for t in batch.column("text").to_pylist()]
        lettered = np.array([any(map(str.isalpha, t)) for t in texts], bool)
        if not model.languages:
            lettered[:] = False
        sure = softmax(model.logits(texts) / model.temperature)
        best = sure.argmax(axis=1)
        names = [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered)]
        value = np.where(lettered, sure[np.arange(len(best)), best], 0.0)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(value), pa.array(lettered & (value >= model.threshold))],
            names=["doc_id", "lang_pred", "score", "accepted"],
        )

    return by_rows(rows, score, f"doc_id {kind}, lang_pred string, score double, accepted boolean")


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Train on the labelled documents and predict for all: doc_id, held_out, lang_pred, score, accepted."""
    result = predict(docs, fit(docs, doc_id, text, lang), doc_id, text)
    return result.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score", "accepted")


def keep_identified(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents whose language is accepted, with all their columns, in one narrow pass.

    Only texts go to Python; the verdict comes back beside the row, so repeated and null ids need no join.
    """
    model = fit(docs, doc_id, text, lang)

    @F.arrow_udf("boolean")
    def accepted(column: pa.Array) -> pa.Array:
        found = []
        for start in range(0, len(column), STEP_ROWS):
            texts = [t or "" for t in column.slice(start, STEP_ROWS).to_pylist()]
            sure = softmax(model.logits(texts) / model.temperature).max(axis=1)
            ok = np.array([any(map(str.isalpha, t)) for t in texts], bool) & (sure >= model.threshold)
            found.append(ok & bool(model.languages))
        return pa.array(np.concatenate(found) if found else np.zeros(0, bool))

    return docs.filter(accepted(F.col(f"`{text}`")))
