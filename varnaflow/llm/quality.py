"""Quality classifier by co-training.

Two views of a document are learnt apart: what its text says (words and shape) and
what its page tells (language, source, length).  In each round every view labels
the unlabelled documents that it is sure of, and these join the other view's
training rows.  Each view is then calibrated on held-out labelled rows, the
calibrated log-odds are combined, and all documents are scored in one pass.
It is done for two labels: quality, and toxicity.

Fitting uses at most ``labelled`` labelled documents, the first by a hash of
doc_id.  Every unlabelled document is scored in each round, in one pass over stored
features, and the surest of all of them are given; features of labelled and given
documents come to the driver, texts never do.  Scoring is row-local and reads every
document whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_by_bytes, free_names, row_key, stored, utf8
from .wordhash import mix, word_hashes, word_spans

#: Labelled rows that the classifiers are fitted on, at most.
LABELLED = 8_000
#: Bytes of their features, at most: a very long document has half a megabyte.
LABELLED_BYTES = 256 << 20
ROUNDS = 3
#: Pseudo-labels need this probability, and a view gives at most this many of each class in a round.
SURE = 0.97
GIVEN = 400
BUCKETS = 1 << 18
#: Bytes of text whose features a worker makes at once, one document at least.
SLICE = 1 << 19
#: Bytes of a word that are a feature: its beginnings, for languages that inflect, and the whole.
PREFIXES = (4, 5, 6, 1 << 20)
#: Features whose share differs between the classes by fewer standard errors are noise.
LEAST_Z = 5.0
#: A document goes if it is this likely to be of low quality, or toxic.
REJECT_LOW, REJECT_TOXIC = 0.5, 0.5

_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_UPPER = np.array([65 <= c <= 90 for c in range(256)])
_DIGIT = np.array([48 <= c <= 57 for c in range(256)])
_MARK = np.array([33 <= c <= 47 or 58 <= c <= 64 or 91 <= c <= 96 or 123 <= c <= 126 for c in range(256)])
N_SHAPE = 10


def text_features(texts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Shape numbers of each text, and the buckets of its different words."""
    shape = np.zeros((len(texts), N_SHAPE), np.float32)
    data = b"\n".join(texts).translate(_PLAIN)
    starts, ends = word_spans(data)
    bounds = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    hashes = [word_hashes(data, starts, np.minimum(ends, starts + n)) + np.uint64(n) for n in PREFIXES]
    bucket = np.stack([(h % np.uint64(BUCKETS)).astype(np.int64) for h in hashes])
    words = [np.unique(bucket[:, a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    for i, t in enumerate(texts):
        b = np.frombuffer(t, np.uint8)
        n, parts = max(1, len(b)), t.split()
        m = max(1, len(parts))
        mark = _MARK[b]
        doubled = int((mark[1:] & (b[1:] == b[:-1])).sum()) if len(b) > 1 else 0
        letters = max(1, int((b >= 65).sum()))
        lines = t.split(b"\n")
        shape[i] = (
            math.log1p(m),
            _UPPER[b].sum() / letters,
            mark.sum() / n,
            doubled / m,
            sum(len(p) == 1 and not p.isalnum() for p in parts) / m,
            _DIGIT[b].sum() / n,
            len(words[i]) / m / len(PREFIXES),
            1 - len(set(lines)) / len(lines),
            n / m / 10,
            math.log1p(doubled),
        )
    return shape, words


def meta_features(lang: list, source: list, n_chars: list, sizes: list[int]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The view of the page: log length and its difference to the text's, and buckets of language and source."""
    length = np.array([float(x or 0) for x in n_chars], np.float32)
    numbers = np.stack([np.log1p(np.maximum(length, 0)), (length <= 0).astype(np.float32)], axis=1) if len(length) else np.zeros((0, 2), np.float32)
    data = [b"l=%b" % str(x).encode("utf-8", "replace").replace(b" ", b"_") for x in lang]
    data2 = [b"s=%b" % str(x).encode("utf-8", "replace").replace(b" ", b"_") for x in source]

    def buckets(values: list[bytes]) -> np.ndarray:
        joined = b"\n".join(v.translate(bytes.maketrans(b"\t\n\v\f\r", b"_____")) for v in values)
        return (word_hashes(joined, *word_spans(joined)) % np.uint64(BUCKETS)).astype(np.int64)

    return numbers, [np.unique([a, b]) for a, b in zip(buckets(data), buckets(data2), strict=True)] if lang else []


@dataclass
class View:
    """A logistic model over numbers (scaled) and present buckets."""

    mean: np.ndarray
    scale: np.ndarray
    numbers: np.ndarray
    words: np.ndarray
    bias: float

    def logit(self, x: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
        sizes = np.array([len(w) for w in words], np.int64)
        flat = np.concatenate([*words, np.zeros(0, np.int32)])
        sums = np.concatenate([[0], np.cumsum(self.words[flat])])
        ends = np.cumsum(sizes)
        return (x - self.mean) / self.scale @ self.numbers + sums[ends] - sums[ends - sizes] + self.bias


def fit_view(x: np.ndarray, words: list[np.ndarray], y: np.ndarray, steps: int = 150, ridge: float = 2e-4, least: int = 4) -> View:
    """Logistic regression by Adam; buckets in fewer than ``least`` rows are left out.  Classes weigh alike."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = (x - mean) / scale
    sizes = np.array([len(w) for w in words], np.int64)
    flat, row = np.concatenate([*words, np.zeros(0, np.int32)]).astype(np.int32), np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    seen = np.bincount(flat, minlength=BUCKETS)
    high = np.bincount(flat[(y > 0.5)[row]], minlength=BUCKETS)
    n1, n = max(1.0, y.sum()), len(y)
    n0 = max(1.0, n - n1)
    share = seen / max(1, n)
    z_score = np.abs(high / n1 - (seen - high) / n0) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n1 + 1 / n0))
    used = np.flatnonzero((seen >= least) & (z_score >= LEAST_Z))
    number = np.full(BUCKETS, -1, np.int32)
    number[used] = np.arange(len(used), dtype=np.int32)
    keep = number[flat] >= 0
    flat, row = number[flat[keep]], row[keep]
    positive = max(1.0, y.sum())
    weight = np.where(y > 0.5, len(y) / 2 / positive, len(y) / 2 / max(1.0, len(y) - positive)) / len(y)
    theta = np.zeros(len(used) + x.shape[1] + 1)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, a = theta[: len(used)], theta[len(used) : -1]
        logit = np.bincount(row, w[flat], len(y)) + z @ a + theta[-1]
        error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) * weight
        gradient = np.concatenate([np.bincount(flat, error[row], len(used)), error @ z, [error.sum()]])
        gradient[:-1] += ridge * theta[:-1]
        m = 0.9 * m + 0.1 * gradient
        v = 0.99 * v + 0.01 * gradient**2
        theta -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    full = np.zeros(BUCKETS)
    full[used] = theta[: len(used)]
    return View(mean, scale, theta[len(used) : -1], full, float(theta[-1]))


def calibrated(logits: np.ndarray, y: np.ndarray, steps: int = 400) -> np.ndarray:
    """Weights and bias that turn views' logits (columns) into log-odds; a view never counts backwards."""
    theta = np.zeros(logits.shape[1] + 1)
    theta[:-1] = 0.5
    x = np.concatenate([np.clip(logits, -20, 20), np.ones((len(logits), 1))], axis=1)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        error = (1 / (1 + np.exp(-np.clip(x @ theta, -30, 30))) - y) / max(1, len(y))
        gradient = error @ x
        gradient[:-1] += 1e-4 * theta[:-1]
        m = 0.9 * m + 0.1 * gradient
        v = 0.99 * v + 0.01 * gradient**2
        theta -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        theta[:-1] = np.maximum(theta[:-1], 0)
    return theta


@dataclass
class Target:
    """Both views of one label and how to combine them."""

    text: View
    meta: View
    weights: np.ndarray

    def probability(self, text: tuple, meta: tuple) -> np.ndarray:
        logit = self.text.logit(*text) * self.weights[0] + self.meta.logit(*meta) * self.weights[1] + self.weights[2]
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _take(view: tuple[np.ndarray, list[np.ndarray]], rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    return view[0][rows], [view[1][i] for i in rows.tolist()]


class Learner:
    """Co-training of one label; ``labelled`` is (text view, meta view) features, ``held`` marks rows for calibration."""

    def __init__(self, labelled: list[tuple], y: np.ndarray, held: np.ndarray) -> None:
        train, hold = np.flatnonzero(~held), np.flatnonzero(held)
        self.rows = [[_take(v, train), y[train]] for v in labelled]
        self.held, self.truth = [_take(v, hold) for v in labelled], y[hold]
        self.taken: list[set[tuple[int, int]]] = [set(), set()]
        self.refit()

    def refit(self) -> None:
        self.views = [fit_view(x, words, target) for (x, words), target in self.rows]
        self.single = [calibrated(v.logit(*h)[:, None], self.truth) for v, h in zip(self.views, self.held, strict=True)]

    def give(self, k: int, high: list[tuple], low: list[tuple], features: dict[tuple, tuple]) -> None:
        """View ``k`` learns documents that the other is sure of."""
        some = [*high, *low]
        self.taken[k].update(some)
        if some:
            (x, words), target = self.rows[k]
            more = [features[i][k] for i in some]
            self.rows[k] = [(np.concatenate([x, np.stack([a for a, _ in more])]), words + [b for _, b in more]), np.concatenate([target, np.ones(len(high)), np.zeros(len(low))])]

    def target(self) -> Target:
        logits = np.stack([v.logit(*h) for v, h in zip(self.views, self.held, strict=True)], axis=1)
        return Target(self.views[0], self.views[1], calibrated(logits, self.truth))


@dataclass
class Model:
    """``None`` for a label that no row, or only rows of one class, have."""

    quality: Target | None
    toxic: Target | None


#: Numbers as 32-bit floats, buckets packed.
_FEATURES = "doc_id long, row long, shape binary, words binary, numbers binary, pages binary"
_PARTS = BUCKETS >> 16
_INPUT = ("text", "lang", "source", "n_chars")


def _input(docs: DataFrame) -> list[Column]:
    """The four columns read; one that is missing is null."""
    kinds = {"text": "string", "lang": "string", "source": "string", "n_chars": "double"}
    return [(F.col(f"`{c}`") if c in docs.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in _INPUT]


def _views(batch: pa.RecordBatch) -> tuple[tuple, tuple]:
    raw = utf8(batch.column("text"))
    return text_features(raw), meta_features(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("n_chars").to_pylist(), [len(t) for t in raw])


def _packed(buckets: np.ndarray) -> bytes:
    """Sorted buckets as how many have each high part, and low parts of 16 bits."""
    return np.bincount(buckets >> 16, minlength=_PARTS).astype("<u4").tobytes() + (buckets & 0xFFFF).astype("<u2").tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    counts = np.frombuffer(blob, "<u4", _PARTS)
    return np.frombuffer(blob, "<u2", offset=4 * _PARTS).astype(np.int32) + np.repeat(np.arange(_PARTS, dtype=np.int32) << 16, counts)


def _features(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in rows:
        for batch in batches_by_bytes(whole, "text", SLICE):
            (shape, words), (numbers, pages) = _views(batch)
            blobs = ([x.astype("<f4").tobytes() for x in shape], [_packed(x) for x in words], [x.astype("<f4").tobytes() for x in numbers], [_packed(x) for x in pages])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), *(pa.array(b, pa.binary()) for b in blobs)], ["doc_id", "row", "shape", "words", "numbers", "pages"])


def _read(rows: pa.RecordBatch | pa.Table) -> list[tuple]:
    """(text view, meta view) of rows of features."""
    column = lambda name: rows.column(name).to_pylist()
    shape, numbers = (np.frombuffer(b"".join(column(c)), "<f4").reshape(rows.num_rows, width) for c, width in (("shape", N_SHAPE), ("numbers", 2)))
    return [(shape, [_unpacked(b) for b in column("words")]), (numbers, [_unpacked(b) for b in column("pages")])]


def view_logits(features: DataFrame, learners: list[Learner]) -> DataFrame:
    """(doc_id, row, logits) of every row: the calibrated log-odds of each learner's two views."""
    shared = features.sparkSession.sparkContext.broadcast([(x.views, x.single) for x in learners])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in rows:
            for batch in batches_by_bytes(whole, "words", 2 << 20):
                both = _read(batch)
                out = [v.logit(*both[k]) * single[k][0] + single[k][1] for views, single in shared.value for k, v in enumerate(views)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(np.stack(out, axis=1).tolist(), pa.list_(pa.float64()))], ["doc_id", "row", "logits"])

    return features.mapInArrow(run, "doc_id long, row long, logits array<double>")


def surest(logits: DataFrame, place: int, taken: set[tuple[int, int]], high: bool, sure: float = SURE, given: int = GIVEN) -> list[tuple[int, int]]:
    """(doc_id, row) of the ``given`` most certain documents of one class that the other view hasn't been given."""
    x = F.element_at("logits", place + 1) * (1 if high else -1)
    found = logits.where(x >= math.log(sure / (1 - sure))).groupBy("doc_id", "row").agg(F.max(x).alias("x")).orderBy(F.desc("x"), "doc_id", "row").limit(given + len(taken)).collect()
    return [i for r in found if (i := (r["doc_id"], r["row"])) not in taken][:given]


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS) -> Model:
    """Fit on a bounded sample of labelled documents and on the surest of all others.

    Labels that are null, or of unknown documents, are not used.  A document that is
    labelled more than once has the least quality and the most toxicity of its
    labels; of rows that repeat a labelled doc_id one is learnt, the least by hash
    of its text.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and (quality is not null or toxic is not null)")
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null")
    chosen = known.join(ids, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(labelled).collect()
    label = {r["doc_id"]: (r["quality"], r["toxic"]) for r in chosen}
    if not label:
        return Model(None, None)
    session = docs.sparkSession
    features = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row"), *_input(docs)).where("doc_id is not null").mapInArrow(_features, _FEATURES), "features")
    few = F.broadcast(session.createDataFrame([(i,) for i in label], "doc_id long"))  # at most labelled ids
    first = features.join(few, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("row").alias("row"), F.max(F.octet_length("words")).alias("bytes")).collect()
    place = {i: n for n, i in enumerate(label)}
    learnt, size = [], 0
    for r in sorted(first, key=lambda r: place[r["doc_id"]]):
        size += r["bytes"]
        if size <= LABELLED_BYTES:
            learnt.append((r["doc_id"], r["row"]))
    few = F.broadcast(session.createDataFrame(learnt, "doc_id long, row long"))
    rows = features.join(few, ["doc_id", "row"], "left_semi").dropDuplicates(["doc_id", "row"]).toArrow().combine_chunks().sort_by([("doc_id", "ascending"), ("row", "ascending")])
    at, views = rows["doc_id"].to_numpy(), _read(rows)
    del rows
    learners: list[Learner | None] = []
    for k in range(2):
        mine = np.array([i for i in range(len(at)) if label[int(at[i])][k] is not None], np.int64)
        y = np.array([float(label[int(at[i])][k]) for i in mine.tolist()])
        held = mix(at[mine].astype(np.uint64)) % np.uint64(5) == 0  # a fifth, by hash
        enough = all(len(np.unique(y[part])) == 2 for part in (held, ~held))
        learners.append(Learner([_take(v, mine) for v in views], y, held) if enough else None)
    able = [x for x in learners if x]
    for _ in range(rounds if able else 0):
        free = stored(view_logits(features, able).join(known.select("doc_id").distinct(), "doc_id", "left_anti"), "logits")
        # what view k is sure of goes to the other view
        gifts = [(x, 1 - k, *(surest(free, 2 * n + k, x.taken[1 - k], high) for high in (True, False))) for n, x in enumerate(able) for k in range(2)]
        wanted = sorted({i for _, _, high, low in gifts for i in [*high, *low]})
        if not wanted:
            break
        some = F.broadcast(session.createDataFrame(wanted, "doc_id long, row long"))
        rows = features.join(some, ["doc_id", "row"], "left_semi").dropDuplicates(["doc_id", "row"]).toArrow().combine_chunks()
        (shape, words), (numbers, pages) = _read(rows)
        found = {(i, r): ((shape[n], words[n]), (numbers[n], pages[n])) for n, (i, r) in enumerate(zip(rows["doc_id"].to_pylist(), rows["row"].to_pylist(), strict=True))}
        del rows
        for x, k, high, low in gifts:
            x.give(k, high, low, found)
        for x in able:
            x.refit()
    return Model(*[x and x.target() for x in learners])


def score(docs: DataFrame, model: Model, name: str | None = None) -> DataFrame:
    """All columns of ``docs`` and a struct column of p_quality, p_toxic and keep.

    The new column is the last; it is called ``name``, or else ``cotrained`` or the
    next such name that is free.  A null text is empty and is scored as such, as are
    texts without words; long texts are read whole.  A label without a classifier
    has a null probability and rejects nothing.  Rows with a null or repeated doc_id
    are scored each by itself.  An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("p_quality double, p_toxic double")
    def run(text: pa.Array, lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> pa.Array:
        out: list[np.ndarray] = []
        for part in batches_by_bytes(pa.RecordBatch.from_arrays([text, lang, source, n_chars], list(_INPUT)), "text", SLICE):
            both = _views(part)
            out.append(np.stack([t.probability(*both) if t else np.full(len(part), np.nan) for t in (shared.value.quality, shared.value.toxic)], axis=1))
        p = np.concatenate([*out, np.zeros((0, 2))])
        return pa.StructArray.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], ["p_quality", "p_toxic"])

    (free,) = free_names(docs.columns, name or "cotrained")
    own = F.col(f"`{free}`")
    scored = docs.withColumn(free, run(*_input(docs)))
    known = [F.nullif(own[c], F.lit(float("nan"))).alias(c) for c in ("p_quality", "p_toxic")]
    low = F.coalesce(1 - own["p_quality"] > REJECT_LOW, F.lit(False))
    toxic = F.coalesce(own["p_toxic"] > REJECT_TOXIC, F.lit(False))
    scored = scored.withColumn(free, F.struct(*known))
    return scored.withColumn(free, F.struct(own["p_quality"].alias("p_quality"), own["p_toxic"].alias("p_toxic"), (~low & ~toxic).alias("keep")))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, p_quality, p_toxic, keep for every row of ``docs``; rows are treated as ``score`` and labels as ``fit`` say."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_input(docs))
    return score(slim, fit(docs, labels)).select("doc_id", "cotrained.p_quality", "cotrained.p_toxic", "cotrained.keep")


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected, with their columns; rows are treated as ``score`` and labels as ``fit`` say."""
    scored = score(docs, fit(docs, labels))
    return scored.where(F.col(f"`{scored.columns[-1]}`")["keep"]).select(*[F.col(f"`{c}`") for c in docs.columns])
