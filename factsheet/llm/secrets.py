"""Secret scan: patterns propose candidates, a random forest removes the false ones.

Candidates are runs of key characters: 16 or more with a digit, or 20 or more of any, cut at '=' inside;
the whole quoted or unspaced value behind a name that says so; and the password in a URL, these of ``SHORTEST``
characters or more. Where they overlap, each is a candidate of its own. A candidate's
features are its length, its character transitions, how much of it is covered by dictionary words,
the path it lies in, and the words beside it. The forest is trained on labelled findings, given
by the caller or derived by ``self_evident``: candidates in the format of a known
issuer, or assigned to a name that says so, against plain words and candidates that name a digest.

The dictionary is the ``dictionary_words`` commonest words of all documents. The forest is fitted on at
most about ``most_labelled`` findings, taken by a hash: its documented bound.

Defined cases: null and empty texts have no candidate; equal rows get equal results; with no labelled
finding of one of the two kinds the label itself, else the format alone, decides; empty tables give
empty results; columns other than the named ones are never read.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factsheet.llm.common import picked, stored, unit_hash

CANDIDATE = re.compile(r"[A-Za-z0-9_+/=-]{16,}")
NEAR = 40
#: Characters of an assigned value or a URL's password at least.
SHORTEST = 6
#: Formats of known issuers: fixed values.
FORMATS = {
    "aws_key": re.compile(r"(AKIA|ASIA)[A-Z0-9]{16}"),
    "github": re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}"),
    "slack": re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    "stripe": re.compile(r"[sr]k_(live|test)_[A-Za-z0-9]{16,}"),
    "google": re.compile(r"AIza[A-Za-z0-9_-]{35}"),
    "openai": re.compile(r"sk-[A-Za-z0-9_-]{20,}"),
}
ASSIGNED = re.compile(r"(?i)(token|secret|passw(or)?d|pwd|api_?key|access_?key|auth|credential|private_?key)\w*[\"']?\s*(=|:|=>|:=)\s*[\"']?$")
#: A word before a sign of assignment, tried from its start alone, so that a long run is read once.
NAME = re.compile(r"""(?<!\w)(?P<name>\w++)["']?\s*+(?:=>|:=|=|:)\s*+""")
NAMED = re.compile(r"(?i)token|secret|passw(or)?d|pwd|api_?key|access_?key|auth|credential|private_?key")
#: The value behind it: what its quotes hold, or all up to white space.
VALUE = re.compile(r"""(?:"(?P<double>[^"\n]+)"|'(?P<single>[^'\n]+)'|(?P<bare>[^\s"'`]+))""")
URL = re.compile(r"[A-Za-z][A-Za-z0-9+.-]{0,30}://[^\s/:@]*:(?P<password>[^\s/]+)@")
#: What each text with a candidate holds.
MAY_HOLD = r"[A-Za-z0-9_+/=-]{16}|://[^\s/:@]*:|(?i:token|secret|passw|pwd|api_?key|access_?key|auth|credential|private_?key)"
SECRET_WORD = re.compile(r"(?i)token|secret|passw|pwd|key|auth|credential|bearer")
DIGEST_WORD = re.compile(r"(?i)\b(sha-?(1|256|512)?|md5|commit|checksum|digest|hash|revision|uuid|guid|etag|integrity)\b")
EXAMPLE_WORD = re.compile(r"(?i)\b(example|sample|dummy|fake|test|placeholder|your[_-])")
CONFIG_PATH = re.compile(r"(?i)\.(env|ini|cfg|conf|ya?ml|toml|properties|pem|tfvars)\b|config|secret|credential")
TEST_PATH = re.compile(r"(?i)test|spec|example|sample|doc|fixture|vendor|node_modules|\.lock\b")
KINDS = "ulds"
FEATURES = (
    ["length", "entropy", "distinct", "hex", "longest_run"]
    + [f"to_{a}{b}" for a in KINDS for b in KINDS]
    + ["dictionary", "config_path", "test_path", "path_depth", "secret_word", "digest_word", "example_word", "assigned", "quoted", "left_words"]
)


def kind(c: str) -> int:
    return 0 if "A" <= c <= "Z" else 1 if "a" <= c <= "z" else 2 if "0" <= c <= "9" else 3


def coverage(value: str, dictionary: set[str], longest: int) -> float:
    """Share of the characters that words of the dictionary cover, taken from the left, the longest first."""
    low, at, hit = value.lower(), 0, 0
    while at < len(low):
        for size in range(min(longest, len(low) - at), 2, -1):
            if low[at : at + size] in dictionary:
                at, hit = at + size, hit + size
                break
        else:
            at += 1
    return hit / len(value)


def features(value: str, left: str, right: str, path: str, dictionary: set[str], longest: int) -> list[float]:
    n = len(value)
    counts = [value.count(c) for c in set(value)]
    moves = [0] * 16
    kinds = [kind(c) for c in value]
    run = most = 1
    for a, b in zip(kinds[:-1], kinds[1:]):
        moves[4 * a + b] += 1
        run = run + 1 if a == b else 1
        most = max(most, run)
    beside = left + " " + right
    return [
        math.log(n), -sum(c / n * math.log2(c / n) for c in counts), len(counts) / n, float(all(c in "0123456789abcdefABCDEF" for c in value)), most / n,
        *[m / (n - 1) for m in moves],
        coverage(value, dictionary, longest), float(bool(CONFIG_PATH.search(path))), float(bool(TEST_PATH.search(path))), float(path.count("/")),
        float(bool(SECRET_WORD.search(left))), float(bool(DIGEST_WORD.search(left))), float(bool(EXAMPLE_WORD.search(beside))), float(bool(ASSIGNED.search(left))),
        float(left[-1:] in "\"'`" and right[:1] in "\"'`" and bool(left) and bool(right)), float(len(left.split())),
    ]


def self_evident(value: str, left: str) -> tuple[str | None, int | None]:
    """Format of a known issuer, and a label where the finding speaks for itself."""
    found = next((name for name, pattern in FORMATS.items() if pattern.fullmatch(value)), None)
    if found:
        return found, 1
    mixed = any("0" <= c <= "9" for c in value)
    if mixed and ASSIGNED.search(left) and not DIGEST_WORD.search(left):
        return None, 1
    if value.isalpha() or DIGEST_WORD.search(left):
        return None, 0
    return None, None


def assigned(text: str) -> list[tuple[int, int]]:
    """Spans of the values behind names of secrets."""
    spans, at = [], 0
    while m := NAME.search(text, at):
        at = m.end()
        if NAMED.search(m.group("name")) and (value := VALUE.match(text, at)):
            start, at = value.span(value.lastgroup)
            end = start + len(text[start:at].rstrip(",;)]}")) if value.lastgroup == "bare" else at
            spans.append((start, end))
            at = value.end()
    return spans


def proposed(text: str) -> list[tuple[int, int, bool]]:
    """Spans of the candidates of a text, each once, by start; whether it is the password in a URL."""
    found = {}
    for m in CANDIDATE.finditer(text):
        # A name assigned without spaces belongs to the context, not to the value; either side may be one.
        start, body = m.start(), m.group().rstrip("=")
        pieces = body.split("=")
        for k, piece in enumerate(pieces):
            end = start + len(piece) if k < len(pieces) - 1 else m.end()
            if end - start >= 20 or (end - start >= 16 and any("0" <= c <= "9" for c in text[start:end])):
                found[start, end] = False
            start = end + 1
    for start, end in assigned(text):
        if end - start >= SHORTEST:
            found.setdefault((start, end), False)
    for m in URL.finditer(text):
        if len(m.group("password")) >= SHORTEST:
            found[m.span("password")] = True
    return [(a, b, url) for (a, b), url in sorted(found.items())]


def dictionary(docs: DataFrame, text: str = "text", size: int = 4000) -> set[str]:
    """The commonest words of 3 to 12 letters in all documents."""
    each = docs.select(F.explode(F.regexp_extract_all(F.lower(F.col(f"`{text}`")), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    counts = each.filter(F.length("word").between(3, 12)).groupBy("word").count()
    return {r["word"] for r in counts.orderBy(F.desc("count"), "word").limit(size).collect()}


def candidates(docs: DataFrame, words: set[str], doc_id: str = "doc_id", text: str = "text", path: str | None = "source") -> DataFrame:
    """One row per candidate: doc_id, start, end (code points), value, format, label (null: unknown), features."""
    rows = picked(docs, (doc_id, "doc_id"), (text, "text"), *([(path, "path")] if path else []))
    kind_of_id = rows.schema["doc_id"].dataType.simpleString()
    where = F.coalesce(F.col("path").cast("string"), F.lit("")) if path else F.lit("")
    rows = rows.select("doc_id", "text", where.alias("path")).filter(F.col("text").rlike(MAY_HOLD))
    longest = max(map(len, words), default=0)
    schema = f"doc_id {kind_of_id}, start int, end int, value string, format string, label int, features array<float>"
    types = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.float32()))

    def find(batches):
        for batch in batches:
            owner, out = [], []
            for i, (t, p) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                for start, end, url in proposed(t):
                    value, left, right = t[start:end], t[max(0, start - NEAR) : start], t[end : end + NEAR]
                    name, label = self_evident(value, left)
                    if url and label is None and not value.isalpha():
                        label = 1
                    owner.append(i)
                    out.append((start, end, value, name, label, features(value, left, right, p, words, longest)))
            columns = list(zip(*out)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, types)]],
                names=["doc_id", "start", "end", "value", "format", "label", "features"],
            )

    return rows.mapInArrow(find, schema)


def train(findings: DataFrame, most_labelled: int = 8_000, trees: int = 24, depth: int = 6) -> RandomForestClassificationModel | None:
    """A forest from findings with features and a label of 0 or 1; None without both kinds."""
    counts = {r["label"]: r["count"] for r in findings.filter("label in (0, 1)").groupBy("label").count().collect()}
    if len(counts) < 2:
        return None
    share = F.when(F.col("label") == 1, most_labelled / 2 / counts[1]).otherwise(most_labelled / 2 / counts[0])
    some = findings.filter("label in (0, 1)").filter(unit_hash(F.col("value"), F.lit("secrets")) < share)
    some = stored(some.select(array_to_vector("features").alias("features"), F.col("label").cast("double").alias("label")), "findings")
    if some.select("label").distinct().count() < 2:
        return None
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=11, featureSubsetStrategy="sqrt").fit(some)


def scan(docs: DataFrame, labelled: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", path: str | None = "source", dictionary_words: int = 4000, least: float = 0.5, most_labelled: int = 8_000) -> DataFrame:
    """All candidates with their verdict: doc_id, start, end, value, format, probability, is_secret.

    ``labelled``: findings with (value, features, label); by default the self-evident ones of ``docs``.
    """
    found = stored(candidates(docs, dictionary(docs, text, dictionary_words), doc_id, text, path), "candidates")
    model = train(found if labelled is None else labelled, most_labelled)
    if model is None:
        sure = F.coalesce(F.col("label"), F.col("format").isNotNull().cast("int")).cast("double")
        scored = found.withColumn("probability", sure)
    else:
        scored = model.transform(found.withColumn("features", array_to_vector("features"))).withColumn("probability", vector_to_array("probability")[1])
    verdict = F.col("probability") >= least
    return scored.select("doc_id", "start", "end", "value", "format", "probability", verdict.alias("is_secret"))
