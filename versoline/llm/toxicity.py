"""Toxicity: a linear-chain conditional random field that tags toxic spans.

Chains are sentences (runs of words up to one that ends in . ! or ?) with two states. A word's emission
is a sum of hashed features: the lower-cased word, its prefixes, its shape. Training needs labelled
tokens, but labels are per document; so markers are induced first: a feature whose documents are toxic
far more often than chance allows, corrected for the number of features tested and with near copies in
the sample counted once, labels the tokens that carry it. The field is then fitted to those tags, and
generalises from them by its affixes.

Scoring runs forward-backward over every sentence of the whole text. Marginals aggregate to a document score by a
calibrated logistic over the strongest token and the expected number of toxic tokens; tokens with a
marginal of 1/2 or more are the offending spans.

Defined cases: null and empty texts, and texts without words, score as a text with no toxic token; equal
texts score alike, wherever they stand; without labels, or with one class only, the score is the share of
toxic labels (0 without labels). Labels that repeat a doc_id count as toxic if one of them is.
"""

from __future__ import annotations

import re
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import aside, give_back, held, in_slices, table, words_of

#: Size of the feature table.
DIMS = 1 << 18
#: The training sample: documents of either class at most, of whatever length.
SAMPLE_TOXIC, SAMPLE_CLEAN = 600, 1000
#: Words whose emissions a worker keeps.
KEPT_WORDS = 150_000

CORE = re.compile(r"[^\W_](?:.*[^\W_])?", re.S)

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("probability", T.DoubleType())]))
ADDED = [T.StructField("toxicity", T.DoubleType()), T.StructField("toxic_spans", SPANS)]


def features(word: str) -> list[str]:
    """The features of a word: identity and affixes of its letters and digits, and its shape."""
    found = CORE.search(word)
    if not found:
        return ["w:", "shape:none"]
    core = found[0].lower()
    if len(core) > 64:  # not a word of a language; its affixes tell enough
        core = core[:32] + core[-32:]
    out = ["w:" + core, "shape:" + ("digits" if any(c.isdigit() for c in core) else "upper" if found[0].isupper() else "word")]
    return out + [f"p{k}:" + core[:k] for k in range(3, 8) if k < len(core)]


def ids_of(word: str) -> list[int]:
    """The features as 32-bit numbers: the word's first, then its shape's, then those of prefixes."""
    return [zlib.crc32(f.encode()) for f in features(word)]


def slots(word: str) -> list[int]:
    return [f % DIMS for f in ids_of(word)]


def sentence_starts(offsets: np.ndarray, codes: np.ndarray, dictionary: pa.Array) -> np.ndarray:
    """Positions of words at which a chain starts; rows never share one."""
    ends = pc.match_substring_regex(dictionary, "[.!?]$").to_numpy(zero_copy_only=False).astype(bool) if len(dictionary) else np.zeros(0, bool)
    starts = np.zeros(len(codes) + 1, bool)
    starts[1:] = ends[codes]
    starts[offsets[:-1]] = True
    return np.flatnonzero(starts[:-1])


def lanes(starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Chains by length, longest first, and for each step how many are that long."""
    lengths = np.diff(np.append(starts, n))
    order = np.argsort(-lengths, kind="stable")
    live = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), side="left")
    return starts[order], live


def marginals(emission: np.ndarray, trans: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """P(state 1) of each token, expected transitions (2 x 2), and the log of all chains' partition sums.

    State 0 emits 0, state 1 emission. trans: start of state 1, then scores of 01, 10, 11 (00 is 0). All chains advance
    together, a step at a time; messages are log ratios and normalisers, so long chains don't overflow.
    """
    n = len(emission)
    first, live = lanes(starts, n)
    begin, t01, t10, t11 = trans
    forward = np.empty(n)  # log alpha1 - log alpha0
    backward = np.zeros(n)  # log beta1 - log beta0
    log_z = 0.0
    for t, m in enumerate(live):
        at = first[:m] + t
        if t == 0:
            forward[at] = begin + emission[at]
            continue
        r = forward[at - 1]
        zero, one = np.logaddexp(0.0, r + t10), np.logaddexp(t01, r + t11)
        forward[at] = one - zero + emission[at]
        log_z += zero.sum()
    lengths = np.zeros(len(first), np.int64)
    for m in live:
        lengths[:m] += 1
    log_z += np.logaddexp(0.0, forward[first + lengths - 1]).sum()
    for t in range(len(live) - 1, 0, -1):
        at = first[: live[t]] + t
        r = backward[at] + emission[at]
        backward[at - 1] = np.logaddexp(t10, r + t11) - np.logaddexp(0.0, r + t01)
    p = 1 / (1 + np.exp(-np.clip(forward + backward, -60, 60)))
    inner = np.ones(n, bool)
    inner[starts] = False
    at = np.flatnonzero(inner)
    left, right = forward[at - 1], emission[at] + backward[at]
    scores = np.stack([np.zeros(len(at)), right + t01, left + t10, left + right + t11])
    scores = np.exp(scores - scores.max(0))
    return p, (scores / scores.sum(0)).sum(1).reshape(2, 2), log_z


@dataclass(frozen=True)
class Model:
    """weights: by slot; trans: see marginals(); calibration: bias, strongest token, expected count."""

    weights: np.ndarray
    trans: np.ndarray
    calibration: np.ndarray

    def emissions(self, words: list[str], known: dict[str, float]) -> np.ndarray:
        """Emissions of words; what is met first, and so is common, is kept in known."""
        into = known if len(known) < KEPT_WORDS else {}
        for w in words:
            if w not in known and w not in into:
                into[w] = float(self.weights[slots(w)].sum())
        return np.fromiter((known[w] if w in known else into[w] for w in words), float, len(words))


def evidence(p: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each row: log odds of the strongest token, and log(1 + expected number of toxic tokens)."""
    out = np.zeros((len(offsets) - 1, 2))
    out[:, 0] = -8.0
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        clipped = np.clip(p, 3e-4, 1 - 3e-4)
        out[full, 0] = np.log(np.maximum.reduceat(clipped, offsets[full]) / (1 - np.maximum.reduceat(clipped, offsets[full])))
        out[full, 1] = np.log1p(np.add.reduceat(np.where(p >= 0.1, p, 0.0), offsets[full]))
    return out


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def families(offsets: np.ndarray, codes: np.ndarray, words: list[str]) -> np.ndarray:
    """A number for each document of the sample, the same for near copies: those that agree in three least hashes of word triples."""
    n = len(offsets) - 1
    parent = np.arange(n)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    base = np.array([zlib.crc32(w.encode()) for w in words], np.uint64)[codes] if len(words) else np.zeros(0, np.uint64)
    triples = base * np.uint64(0x9E3779B97F4A7C15)
    triples[:-1] += base[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    triples[:-2] += base[2:] * np.uint64(0x165667B19E3779F9)
    long = np.flatnonzero(np.diff(offsets) >= 3)
    if not len(long):
        return parent
    inside = np.concatenate([np.arange(offsets[d], offsets[d + 1] - 2) for d in long])
    triples, starts = triples[inside], np.concatenate([[0], np.cumsum(np.diff(offsets)[long] - 2)])[:-1]
    rng = np.random.default_rng(1)
    for _ in range(12):
        least = [np.minimum.reduceat((triples ^ (triples >> np.uint64(29))) * np.uint64(2 * rng.integers(1 << 62) + 1), starts) for _ in range(3)]
        seen: dict[tuple, int] = {}
        for d, *key in zip(long.tolist(), *(x.tolist() for x in least), strict=True):
            parent[root(d)] = root(seen.setdefault(tuple(key), d))
    return np.array([root(d) for d in range(n)])


def distinct_pairs(a: np.ndarray, b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(a.astype(np.int64) * size + b)
    return both // size, both % size


def markers(doc: np.ndarray, word: np.ndarray, toxic: np.ndarray, family: np.ndarray, feature: np.ndarray, owner: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For each entry of feature whether it is a marker: toxic documents have it far more often than chance allows.

    (doc, word): the distinct words of documents; family: see families(), each counts once. (owner, feature, place):
    the features of each word, see ids_of(). A feature in a toxic and b clean families is a marker if 95 % of its families
    are toxic and the chance of so many, at the base rate, is below 5 % over all features tested. A prefix that owes
    four fifths of its count to one word gives way to it.
    """
    own = place != 1
    feature_no = np.unique(feature, return_inverse=True)[1]
    n = feature_no.max() + 1
    ends = np.searchsorted(owner, np.arange(owner.max() + 2))
    counts = np.zeros((2, n), np.int64)
    for label in (0, 1):
        family_of, words = distinct_pairs(family[doc[toxic[doc] == label]], word[toxic[doc] == label], owner.max() + 1)
        if not len(words):
            continue
        many = ends[words + 1] - ends[words]
        at = np.repeat(ends[words], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        seen, _ = distinct_pairs(feature_no[at[own[at]]], np.repeat(family_of, many)[own[at]], len(toxic) + 1)
        counts[label] = np.bincount(seen, minlength=n)
    clean, bad = counts
    base = len(np.unique(family[toxic == 1])) / max(1, len(np.unique(family)))
    base = min(max(base, 1e-6), 1 - 1e-6)
    rate = np.clip(bad / np.maximum(clean + bad, 1), 1e-12, 1 - 1e-12)
    chance = -(clean + bad) * (rate * np.log(rate / base) + (1 - rate) * np.log((1 - rate) / (1 - base)))  # Chernoff's bound
    found = (bad >= 3) & (bad >= 19 * clean) & (chance < np.log(0.05 / max(1, np.count_nonzero(clean + bad))))
    best = np.zeros(n, np.int64)
    np.maximum.at(best, feature_no, bad[feature_no[ends[owner]]])
    return own & found[feature_no] & ((place == 0) | (best < 0.8 * bad)[feature_no])


def train(rows: list[tuple[str, int]], steps: int = 60) -> Model:
    """The field and its calibration from (text, toxic 0 or 1)."""
    toxic = np.array([y for _, y in rows], np.int64)
    none = Model(np.zeros(DIMS, np.float32), np.zeros(4), np.array([-40.0 if not len(rows) or not toxic.any() else 40.0, 0, 0]))
    if not len(rows) or toxic.min() == toxic.max():
        return none
    offsets, codes, dictionary = words_of(pa.array([t for t, _ in rows], pa.large_string()))
    words = dictionary.to_pylist()
    ids, many = array("I"), np.zeros(len(words), np.int64)
    for k, w in enumerate(words):
        found = ids_of(w)
        ids.extend(found)
        many[k] = len(found)
    feature = np.array(ids, np.int64)
    owner = np.repeat(np.arange(len(words)), many)
    place = np.arange(len(feature)) - np.repeat(np.cumsum(many) - many, many)
    marked = np.zeros(len(words), bool)
    if len(words):
        doc, word = distinct_pairs(np.repeat(np.arange(len(rows)), np.diff(offsets)), codes, len(words))
        marked[owner[markers(doc, word, toxic, families(offsets, codes, words), feature, owner, place)]] = True
    marked = marked[codes]
    doc = np.repeat(np.arange(len(rows)), np.diff(offsets))
    tags = (marked & (toxic[doc] == 1)).astype(float)
    has = np.zeros(len(rows), bool)
    has[doc[tags > 0]] = True
    use = (toxic == 0) | has  # a toxic document without a known marker says nothing about its tokens
    if not has.any():
        return Model(none.weights, none.trans, np.array([np.log(toxic.mean() / (1 - toxic.mean())), 0, 0]))
    keep = use[doc]
    starts = np.zeros(len(codes), bool)
    starts[sentence_starts(offsets, codes, dictionary)] = True
    codes_in, tags_in, starts_in = codes[keep], tags[keep], np.flatnonzero(starts[keep])
    flat = feature % DIMS
    inner = np.ones(len(codes_in), bool)
    inner[starts_in] = False
    at = np.flatnonzero(inner)
    pair = (tags_in[at - 1] * 2 + tags_in[at]).astype(int)
    seen = np.bincount(pair, minlength=4).astype(float)
    n, rate = len(codes_in), max(tags_in.mean(), 1e-6)
    weights, trans = np.zeros(DIMS), np.array([np.log(rate), np.log(rate), 0.0, np.log(rate)])
    squares, squares_t = np.full(DIMS, 1e-8), np.full(4, 1e-8)
    # a tagged word counts as tagged by its docs; AdaGrad on the mean log-likelihood with an L2 pull
    for _ in range(steps):
        emission = np.bincount(owner, weights[flat], len(words))[codes_in]
        p, pairs, _ = marginals(emission, trans, starts_in)
        by_word = np.bincount(codes_in, tags_in - p, len(words))
        gradient = np.bincount(flat, by_word[owner], DIMS) - 0.05 * weights
        pairs = pairs.ravel()
        gradient_t = np.array([(tags_in[starts_in] - p[starts_in]).sum(), seen[1] - pairs[1], seen[2] - pairs[2], seen[3] - pairs[3]]) - 0.05 * trans
        squares += gradient**2
        squares_t += gradient_t**2
        weights += 0.6 * gradient / np.sqrt(squares)
        trans += 0.3 * gradient_t / np.sqrt(squares_t)
    model = Model(weights.astype(np.float32), trans, np.zeros(3))
    emission = np.bincount(owner, weights[flat], len(words))[codes]
    p, _, _ = marginals(emission, trans, np.flatnonzero(starts)) if len(codes) else (np.zeros(0), None, None)
    x = np.column_stack([np.ones(len(rows)), evidence(p, offsets)])
    beta = np.zeros(3)
    for _ in range(50):  # Newton steps on the penalised likelihood
        q = logistic(x @ beta)
        h = (x * (q * (1 - q))[:, None]).T @ x + np.diag([1e-3, 1e-1, 1e-1])
        step = np.linalg.solve(h, x.T @ (toxic - q) - np.array([1e-3, 1e-1, 1e-1]) * beta)
        beta += np.clip(step, -2, 2)
        beta[1:] = np.maximum(beta[1:], 0.1)  # more evidence never lowers a score
        if np.abs(step).max() < 1e-8:
            break
    return Model(model.weights, trans, beta)


def scored(texts: pa.Array, model: Model, known: dict[str, float]) -> tuple[np.ndarray, list[list[dict]]]:
    """Scores and offending spans (code points) of texts without nulls."""
    offsets, codes, dictionary = words_of(texts)
    p = np.zeros(0)
    if len(codes):
        emission = model.emissions(dictionary.to_pylist(), known)[codes]
        p, _, _ = marginals(emission, model.trans, sentence_starts(offsets, codes, dictionary))
    scores = logistic(model.calibration[0] + evidence(p, offsets) @ model.calibration[1:])
    hits = np.flatnonzero(p >= 0.5)
    rows = np.searchsorted(offsets, hits, side="right") - 1
    spans: list[list[dict]] = [[] for _ in range(len(texts))]
    for r in np.unique(rows):
        places = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", texts[int(r)].as_py())]
        for h in hits[rows == r]:
            a, b = places[h - offsets[r]]
            spans[r].append({"start": a, "end": b, "probability": float(p[h])})
    return scores, spans


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with toxicity (0 to 1) and toxic_spans added; columns of these names are replaced."""
    names = {f.name for f in ADDED}
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.trans, model.calibration))
    known: dict[str, float] = {}

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, spans = scored(held(batch.column(batch.schema.get_field_index(text))), Model(*sent.value), known)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))
        keep = [n for n in batch.schema.names if n not in names]
        return pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)) for n in keep] + [pa.array(found), pa.array(spans, kind)], keep + ["toxicity", "toxic_spans"])

    return in_slices(docs, text, work, T.StructType([f for f in docs.schema.fields if f.name not in names] + ADDED), 2 << 20)


def held_out(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def sample(docs: DataFrame, labels: DataFrame) -> list[tuple[str, int]]:
    """The bounded training sample, by a hash of the id: texts of whole documents and labels.

    Ids are chosen first, from labels alone; a broadcast of so many ids, whatever the input, fetches their texts. Ids may repeat, so rows are bounded again.
    """
    labels = labels.where(F.col("toxic").isNotNull()).where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic_label"))
    out = []
    for label, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN)):
        ids = labels.where(F.col("toxic_label") == label).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(ids), "doc_id", "left_semi")
        rows = rows.orderBy(F.xxhash64("doc_id", "text"), "doc_id").limit(most)
        texts = rows.toArrow().to_pandas(self_destruct=True).sort_values(["doc_id", "text"], kind="stable")["text"]
        out += [(t, label) for t in texts]
    return out


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    model = train(sample(docs, labels))
    give_back()
    return model


def reject(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs that score below threshold, with the columns of docs."""
    docs, restored = aside(docs, ("doc_id", "text"))
    return restored(score(docs, fit(docs, labels)).where(F.col("toxicity") < threshold))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = score(docs, fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))
    return rows.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.3).cast("int").alias("predicted"))
