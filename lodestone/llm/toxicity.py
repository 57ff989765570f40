"""Toxicity by compression distance.

Zstandard dictionaries are trained on windows of ordinary and of toxic text. A window is compressed with the ordinary
dictionary and with it and a toxic one; the bytes that the toxic one saves are the window's distance. A document's
windows are counted by distance, and a logistic curve over these counts, fitted to labelled documents, turns
thresholds into a calibrated score.

Toxic texts are mostly ordinary prose, so training is contrastive, over windows of five words. In each round, windows
that the toxic dictionary shortens most are taken, and each word is blamed whose removal loses the saving. Words that
are blamed in several different windows and hardly occur in ordinary text make up the next round's dictionary, together
with one trained on windows that hold none of them yet.

Two distances are measured in the end, and count together: of windows of ten words, by a dictionary that zstandard
trains on the toxic windows that hold blamed words; and of each word, by a dictionary of the blamed words, since a word
in a window of others also shows savings by chance. Word distances are remembered.

The compressor looks for no matches in the last bytes of its input and stores what doesn't shrink as it is,
so a short window alone would cost the same with any dictionary. Each is therefore followed by a fixed trailer
that ends all dictionaries and is in no text.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass
from random import Random

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.recall import Recall
from lodestone.llm.worker import give_back, lean

#: Words of a window in training, and when texts are scored.
CONTEXT, SCORED = 5, 10
#: Bytes that are in no UTF-8 text; see above.
TRAILER = bytes(range(128, 192))
#: Words' distances that a generation of a worker's memory holds, and texts that are scored at once.
REMEMBERED, AT_ONCE = 1 << 17, 256
BASE_BYTES, OWN_BYTES = 32768, 4096
ROUNDS = 4
#: Labelled documents of each class that training takes at most, the first by a hash of their ids; the characters that
#: it takes of each, from EXCERPTS places all over a longer one; and windows that a dictionary is trained on.
SAMPLE = 3000
SAMPLED_CHARS, EXCERPTS = 1 << 16, 16
SAMPLED_WINDOWS = 50_000
STRIP = b".,!?;:|#%$&*\"'()"
LEVELS = 8
#: A blamed word needs so many different windows, and so many times as many toxic as ordinary documents.
SUPPORT, CONTRAST = 3, 10


def windows(text: str | None, size: int = CONTEXT) -> list[bytes]:
    words = (text or "").lower().split()
    return [f" {' '.join(words[i : i + size])} ".encode("utf-8", "replace") for i in range(0, len(words), size)]


def trained(size: int, samples: list[bytes]) -> bytes:
    """The content of a dictionary of about ``size`` bytes; of few samples, the samples themselves."""
    if sum(map(len, samples)) < 8 * size:
        return b"".join(samples)[-size:]
    try:
        return zstandard.train_dictionary(size + 600, samples, k=32, d=6).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def compressor(content: bytes):
    params = zstandard.ZstdCompressionParameters(
        window_log=16, hash_log=15, chain_log=15, search_log=5, min_match=4, target_length=0, strategy=zstandard.STRATEGY_GREEDY,
        format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0,
    )
    made = zstandard.ZstdCompressionDict(content + TRAILER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    made.precompute_compress(compression_params=params)
    compress = zstandard.ZstdCompressor(dict_data=made, compression_params=params).compress
    return lambda window: compress(window + TRAILER)


@dataclass
class Model:
    base: bytes
    own: bytes
    phrases: bytes
    weights: list[float]
    centre: list[float]
    scale: list[float]

    def __post_init__(self):
        self.pair = self.known = None

    def __getstate__(self):
        return self.__dict__ | {"pair": None, "known": None}

    def open(self) -> None:
        if self.pair is None:
            self.pair = compressor(self.base), compressor(self.base + self.own), compressor(self.base + self.phrases)
            self.known = Recall(REMEMBERED)

    def distances(self, text: str | None) -> np.ndarray:
        """Of each window of the text."""
        self.open()
        ordinary, _, phrases = self.pair
        return np.array([len(ordinary(w)) - len(phrases(w)) for w in windows(text, SCORED)], np.int64)

    def word_distances(self, text: str | None) -> np.ndarray:
        """Of each word of the text."""
        self.open()
        ordinary, toxic, _ = self.pair
        words = (text or "").lower().split()
        young = self.known.young
        try:
            return np.array([young[w] for w in words], np.int64)
        except KeyError:
            pass
        for word in self.known.missing(set(words)):
            (window,) = windows(word, 1)
            self.known.young[word] = len(ordinary(window)) - len(toxic(window))
        young = self.known.young
        return np.array([young[w] for w in words], np.int64)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """0 without any window, since nothing speaks for the label then."""
        found = features(self, texts)
        return np.where(found[:, 2] > 0, curve(self.weights, (found - self.centre) / self.scale), 0.0)


def curve(weights, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ np.asarray(weights[:-1]) + weights[-1], -30, 30)))


def features(model: Model, texts: list[str | None]) -> np.ndarray:
    """By document, of words and then of windows: largest and mean distance, number, and how many are at or above each
    level, as counts and shares."""
    half = 3 + 2 * LEVELS
    out = np.zeros((len(texts), 2 * half))
    for i, text in enumerate(texts):
        for k, d in enumerate((model.word_distances(text), model.distances(text))):
            if len(d):
                counts = np.bincount(d.clip(0, LEVELS), minlength=LEVELS + 1)[::-1].cumsum()[::-1][1:]
                out[i, k * half : (k + 1) * half] = [d.max(), np.clip(d, -2, 8).mean(), np.log1p(len(d)), *np.log1p(counts), *(10 * counts / len(d))]
    return out


def fit(toxic: list[str], ordinary: list[str], prior: float, seed: int = 7) -> Model:
    """``prior``: the share of toxic documents among labelled ones, which the score is calibrated to."""
    pick = Random(seed)
    some = lambda x: pick.sample(x, min(len(x), SAMPLED_WINDOWS))
    twd, owd = [windows(t) for t in toxic], [windows(t) for t in ordinary]
    tw, ow = [w for x in twd for w in x], [w for x in owd for w in x]
    own_words = lambda x: {v.strip(STRIP) for y in x for v in y.split()}
    tdf, odf = Counter(w for x in twd for w in own_words(x)), Counter(w for x in owd for w in own_words(x))
    base = trained(BASE_BYTES, some(ow))
    ordinary_size = compressor(base)
    lt, lo = [np.array([len(ordinary_size(w)) for w in x], np.int64) for x in (tw, ow)]
    accepted: set[bytes] = set()
    rest = tw
    for _ in range(ROUNDS):
        have = b" ".join([b"", *sorted(accepted, key=lambda w: (tdf[w], w)), b""])[-OWN_BYTES:]
        size = compressor(base + trained(max(512, OWN_BYTES - len(have)), some(rest)) + have)
        dt = lt - [len(size(w)) for w in tw]
        do = lo - [len(size(w)) for w in ow]
        cut = max(float(np.quantile(do, 0.98)) if len(do) else 2.0, 2.0)
        blamed: dict[bytes, set[bytes]] = defaultdict(set)
        for i in np.flatnonzero(dt >= cut).tolist():
            words = tw[i].split()
            for j, raw in enumerate(words):
                word = raw.strip(STRIP)
                if word in accepted or tdf[word] < 3 or odf[word] * CONTRAST > tdf[word]:
                    continue
                without = b" ".join([b"", *words[:j], *words[j + 1 :], b""])
                if dt[i] - (len(ordinary_size(without)) - len(size(without))) >= 2:
                    blamed[word].add(tw[i])
        accepted |= {w for w, seen in blamed.items() if len(seen) >= SUPPORT}
        rest = [w for w in tw if not any(v.strip(STRIP) in accepted for v in w.split())]
        if not rest:
            break
    own = b" ".join([b"", *sorted(accepted, key=lambda w: (tdf[w], w)), b""])[-OWN_BYTES:]
    phrases = trained(OWN_BYTES, some([w for w in tw if any(v.strip(STRIP) in accepted for v in w.split())]))
    model = Model(base, own, phrases, [], [], [])
    x = np.concatenate([features(model, toxic), features(model, ordinary)])
    y = np.array([1.0] * len(toxic) + [0.0] * len(ordinary))
    share = np.where(y == 1, prior / len(toxic), (1 - prior) / len(ordinary)) * len(y)
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.column_stack([(x - centre) / scale, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(40):
        p = curve(w, a[:, :-1])
        step = np.linalg.solve((a * (share * p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(len(w)), a.T @ (share * (p - y)) + 0.1 * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    model.weights, model.centre, model.scale = w.tolist(), centre.tolist(), scale.tolist()
    return model


def held_out(id_col: str):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model | None:
    """A model from at most ``sample`` labelled documents of each class that aren't held out. Without labels of
    both classes there is none. Ids and labels that are null are left out; of rows that share an id, the smallest
    text is taken. Of a long text, ``EXCERPTS`` pieces of ``SAMPLED_CHARS`` characters together are."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").dropDuplicates(["id"])
    known = known.where(~held_out("id"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    size = dict(known.groupBy("y").count().collect())
    long = F.char_length("text")
    each = SAMPLED_CHARS // EXCERPTS
    places = [(F.lit(k) * (long - each) / (EXCERPTS - 1) + 1).cast("int") for k in range(EXCERPTS)]
    some = F.when(long <= SAMPLED_CHARS, F.col("text")).otherwise(F.concat_ws(" ", *(F.substr("text", p, F.lit(each)) for p in places)))
    texts = {}
    for y in (0, 1):
        chosen = known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample).select("id")
        got = rows.join(F.broadcast(chosen), "id").select("id", some.alias("text")).groupBy("id").agg(F.min("text").alias("text")).collect()
        texts[y] = [t for _, t in sorted((r["id"], r["text"]) for r in got)]
    if not texts[0] or not texts[1]:
        return None
    model = fit(texts[1], texts[0], size[1] / (size[0] + size[1]))
    texts.clear()
    give_back()  # later stages share the driver
    return model


@lean
def _score(batches, model: Model | None):
    for batch in batches:
        for k in range(0, batch.num_rows, AT_ONCE):
            part = batch.slice(k, AT_ONCE)
            scores = model.scores(part.column(1).to_pylist()) if model is not None else np.zeros(part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], ["id", "score"])


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, score. Null and empty texts have no windows and score 0;
    without a model all scores are 0. The model is less than 50 KB, whatever it was trained on, and is
    broadcast. Other columns are not read."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known = docs.sparkSession.sparkContext.broadcast(model)
    return source.mapInArrow(lambda batches: _score(batches, known.value), "id bigint, score double")


@lean
def _drop(batches, model: Model, text_col: str, threshold: float):
    for batch in batches:
        texts = batch.column(text_col)
        scores = [model.scores(texts.slice(k, AT_ONCE).to_pylist()) for k in range(0, batch.num_rows, AT_ONCE)]
        yield batch.filter(pa.array(np.concatenate([*scores, []]) < threshold))


def drop_toxic(docs: DataFrame, model: Model | None, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows that score below ``threshold``, with all their columns; without a model, all rows."""
    if model is None:
        return docs
    known = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(lambda batches: _drop(batches, known.value, text_col, threshold), docs.schema)
