"""Language identification with a byte-level convolutional network, trained and applied in numpy.

Bytes are embedded, filters of several widths slide over a fixed-length window, each filter's strongest response is
kept (max pooling), and a softmax layer turns the responses into language probabilities.  A text is cut into
consecutive windows that cover all of it; its probabilities are the mean of its windows', weighted by letters.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.llm.common import release_memory, text_chunks

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBED = 8
UNDETERMINED = "und"
PIECE = 4 << 20


@dataclass
class ByteCNN:
    """Weights; widest filter first in memory as zero-padded columns of one matrix."""

    languages: list[str]
    embed: np.ndarray  # 256 x EMBED
    kernel: np.ndarray  # (max width * EMBED) x (filters of all widths)
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def columns(self, windows: np.ndarray) -> np.ndarray:
        """windows (n, WINDOW + max width - 1) bytes to (n, WINDOW, max width * EMBED)."""
        x = self.embed[windows]
        n, length, e = x.shape
        w = max(WIDTHS)
        s = x.strides
        return np.lib.stride_tricks.as_strided(x, (n, length - w + 1, w * e), (s[0], s[1], s[2])).copy()

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        pooled = np.maximum((self.columns(windows) @ self.kernel).max(axis=1) + self.bias, 0)
        return softmax(pooled @ self.out + self.out_bias)


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def cut_windows(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows that cover each text (bytes between bounds), zero-padded, and the text number of each."""
    lengths = np.diff(bounds)
    counts = (lengths + WINDOW - 1) // WINDOW
    owner = np.repeat(np.arange(len(lengths)), counts)
    first = np.cumsum(counts) - counts
    begin = bounds[:-1][owner] + (np.arange(len(owner)) - first[owner]) * WINDOW
    end = np.minimum(begin + WINDOW, bounds[1:][owner])
    padded = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
    windows = np.zeros((len(owner), WINDOW + max(WIDTHS) - 1), np.uint8)
    if len(owner):
        windows[:, :WINDOW] = padded[begin[:, None] + np.arange(WINDOW)]
        windows[:, :WINDOW][np.arange(WINDOW) >= (end - begin)[:, None]] = 0
    return windows, owner


_LETTER = np.zeros(256, np.float32)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = 1


def predict_texts(model: ByteCNN | None, texts) -> tuple[list[str], np.ndarray]:
    """Language and probability of every text of an Arrow string array; UNDETERMINED and 0 without letters or model."""
    import pyarrow.compute as pc

    n = len(texts)
    labels, scores = [UNDETERMINED] * n, np.zeros(n)
    if model is None:
        return labels, scores
    lettered = np.asarray(pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False), bool)
    for i, j, data, bounds in text_chunks(texts, 1 << 19):
        windows, owner = cut_windows(data, bounds)
        total = np.zeros((j - i, len(model.languages)))
        for at in range(0, len(windows), 128):
            w = windows[at : at + 128]
            weight = _LETTER[w].sum(axis=1, keepdims=True)
            np.add.at(total, owner[at : at + 128], model.probabilities(w) * weight)
        share = total / np.maximum(total.sum(axis=1, keepdims=True), 1e-12)
        best = share.argmax(axis=1)
        for k in np.flatnonzero(lettered[i:j] & (total.sum(axis=1) > 0)):
            labels[i + k], scores[i + k] = model.languages[best[k]], min(1.0, float(share[k, best[k]]))
    return labels, scores


def kernel_mask() -> np.ndarray:
    """Which weights each filter has: as many bytes as its width."""
    w, e = max(WIDTHS), EMBED
    return np.concatenate([np.repeat((np.arange(w * e) < k * e)[:, None], FILTERS, 1) for k in WIDTHS], axis=1).astype(np.float32)


def gradients(model: ByteCNN, windows: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean weighted cross-entropy of windows (n, WINDOW + max width - 1) with classes y."""
    w, n = max(WIDTHS), np.arange(len(windows))
    cols = model.columns(windows)
    response = cols @ model.kernel
    where = response.argmax(axis=1)
    picked = np.take_along_axis(response, where[:, None, :], 1)[:, 0] + model.bias
    pooled = np.maximum(picked, 0)
    d = softmax(pooled @ model.out + model.out_bias)
    d[n, y] -= 1
    d *= weight[:, None] / len(windows)
    dpool = (d @ model.out.T) * (picked > 0)
    taken = cols[n[:, None], where]  # row, filter, column
    dcols = (dpool[:, :, None] * model.kernel.T[None]).reshape(-1, EMBED)
    embed = np.zeros_like(model.embed)
    np.add.at(embed, windows[n[:, None, None], where[:, :, None] + np.arange(w)].reshape(-1), dcols)
    return {"out": pooled.T @ d, "out_bias": d.sum(0), "bias": dpool.sum(0), "kernel": np.einsum("rf,rfc->cf", dpool, taken) * kernel_mask(), "embed": embed}


def train(texts: list[str], labels: list[str], epochs: int = 8, batch: int = 64, rate: float = 4e-3, seed: int = 7) -> ByteCNN | None:
    """Fits the network to labelled windows (the first WINDOW bytes of each text) with Adam on cross-entropy."""
    languages = sorted(set(labels))
    if not languages:
        return None
    w, e, mask = max(WIDTHS), EMBED, kernel_mask()
    rng = np.random.default_rng(seed)
    p = {
        "embed": rng.normal(0, 0.5, (256, e)),
        "kernel": rng.normal(0, 1 / np.sqrt(w * e), mask.shape) * mask,
        "bias": np.zeros(mask.shape[1]),
        "out": rng.normal(0, 0.3, (mask.shape[1], len(languages))),
        "out_bias": np.zeros(len(languages)),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    x = np.zeros((len(texts), WINDOW + w - 1), np.uint8)
    for row, t in zip(x, texts, strict=True):
        raw = np.frombuffer(t.encode()[:WINDOW], np.uint8)
        row[: len(raw)] = raw
    y = np.searchsorted(languages, labels)
    share = np.bincount(y, minlength=len(languages)) / max(1, len(y))
    weight = (1 / (len(languages) * np.maximum(share, 1e-9)))[y].astype(np.float32)
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            g = gradients(ByteCNN(languages, **p), x[rows], y[rows], weight[rows])
            step += 1
            lr = rate * (1 - epoch / epochs)
            for k, grad in g.items():
                m, v = moments[k]
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                p[k] = p[k] - (lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return ByteCNN(languages, **p)


def held_out(id_column: Column) -> Column:
    """Whether crc32 of the id as text leaves remainder 0 by 5; a null id counts as not held out."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, max_docs_per_language: int = 300, windows_per_doc: int = 6, max_languages: int = 1000) -> ByteCNN | None:
    """Learns from documents (doc_id, text, lang) that are not held out and have text and lang.

    The sample is bounded by the parameters: of each label the max_docs_per_language documents with the smallest hash of
    doc_id and text (rows that share them count singly, and no more rows reach the driver), windows_per_doc windows of
    each at positions fixed by a hash. More labels than max_languages are an error, so no label is left out.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n")).limit(max_languages + 1).collect()
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} labels to learn")
    if not counts:
        return None
    limit = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], min(1.0, 1.3 * max_docs_per_language / r["n"]) * (1 << 20))))
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20))
    place = lambda k: (1 + F.pmod(F.xxhash64("doc_id", F.lit(k)), F.greatest(F.length("text") - WINDOW + 1, F.lit(1)))).cast("int")
    pieces = F.array(*(F.substring(F.col("text"), place(k), F.lit(WINDOW)) for k in range(windows_per_doc)))
    chosen = labelled.where(drawn < limit[F.col("lang")]).select("lang", drawn.alias("h"), "doc_id", pieces.alias("pieces"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "pieces"))
    rows = chosen.withColumn("place", first).where(F.col("place") <= max_docs_per_language).collect()
    texts, labels = [], []
    for r in sorted(rows, key=lambda r: (r["lang"], r["place"])):
        for t in sorted(set(r["pieces"])):
            texts.append(t)
            labels.append(r["lang"])
    return train(texts, labels)


def predict(model: ByteCNN | None, text: Column) -> Column:
    """A struct column (lang, score) for a text column; Arrow batches, one pass over the whole text."""
    @F.arrow_udf("struct<lang:string,score:double>")
    def apply(texts: pa.Array) -> pa.Array:
        step = max(1, int(len(texts) * PIECE / max(PIECE, texts.nbytes)))  # rows of about PIECE bytes at a time
        done = [predict_texts(model, texts.slice(i, step)) for i in range(0, len(texts), step)]
        release_memory()
        labels, scores = [x for part, _ in done for x in part], np.concatenate([np.zeros(0), *(s for _, s in done)])
        return pa.StructArray.from_arrays([pa.array(labels, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    return apply(text)


def identify(docs: DataFrame, model: ByteCNN | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row.

    Null text and text without a letter: UNDETERMINED with score 0; repeated rows each give a row; an empty table
    gives none. A model of None (nothing to learn from) calls everything UNDETERMINED. Other columns are ignored.
    """
    found = docs.select("doc_id", predict(model, F.col("text")).alias("_p"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_p.lang").alias("lang_pred"), F.col("_p.score").alias("score"))


def known_language(docs: DataFrame, model: ByteCNN | None, min_score: float = 0.3, languages: list[str] | None = None) -> DataFrame:
    """The rows, with all their columns, whose language is determined with min_score at least (and among languages, if given)."""
    kept = docs.withColumn("__rivulet_p", predict(model, F.col("text")))
    p = F.col("__rivulet_p")
    ok = (p["lang"] != UNDETERMINED) & (p["score"] >= min_score)
    if languages is not None:
        ok &= p["lang"].isin(languages)
    return kept.where(ok).drop("__rivulet_p")


def op3_query(docs: DataFrame) -> DataFrame:
    return identify(docs, fit(docs))
