"""Language identification by a bidirectional gated recurrent network over bytes.

The network labels every byte of a text: two GRUs read windows of WINDOW bytes in both directions, a softmax over their
joint state gives each position's language probabilities, and a document's probabilities are the mean over all its
positions. Trained in numpy by backpropagation through time on a bounded sample of labelled rows; whole texts are read
when predicting. Inference is a mapInArrow over text alone: no shuffle, memory bounded by CHUNK_BYTES.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pinion.llm.common import small, table

WINDOW = 64
HIDDEN = 8
#: The bound on labelled rows that a classifier is fitted on, and on the characters taken of them together; on the languages
#: it learns; characters of a piece of a long text.
SAMPLE_ROWS, SAMPLE_CHARS, LANGUAGES, PIECE = 3000, 24_000_000, 100, 256
STEPS, BATCH, RATE = 300, 192, 0.02
#: Bytes of text that a worker labels at once.
CHUNK_BYTES = 1 << 17
UNDETERMINED = "und"

F32 = np.float32


@dataclass
class Network:
    """w: (2, 256, 3H) input rows by byte, with biases; u: (2, H, 3H); v: (2H, C); c: (C,). Gates in the order z, r, n."""

    langs: list[str]
    w: np.ndarray
    u: np.ndarray
    v: np.ndarray
    c: np.ndarray

    def params(self) -> list[np.ndarray]:
        return [self.w, self.u, self.v, self.c]


def start(langs: list[str], hidden: int, seed: int) -> Network:
    rng = np.random.default_rng(seed)
    return Network(langs, rng.normal(0, 0.5, (2, 256, 3 * hidden)).astype(F32), rng.normal(0, 0.3, (2, hidden, 3 * hidden)).astype(F32), rng.normal(0, 0.3, (2 * hidden, len(langs))).astype(F32), np.zeros(len(langs), F32))


def _gates(a: np.ndarray, hu: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """z, r in one array, by sigmoid(x) = (1 + tanh(x / 2)) / 2; then n. a and hu are overwritten."""
    g, n = a[:, : 2 * k], a[:, 2 * k :]
    g += hu[:, : 2 * k]
    g *= F32(0.5)
    np.tanh(g, out=g)
    g += F32(1)
    g *= F32(0.5)
    own = hu[:, 2 * k :]
    own *= g[:, k:]
    n += own
    np.tanh(n, out=n)
    return g, n


def states(net: Network, x: np.ndarray) -> np.ndarray:
    """x: (T, B) bytes -> (2, T, B, H), the state of both readers after each byte.

    The same recurrence as _gates, with the halves folded into the weights and each gate in an array of its own, so that
    every operation runs over contiguous memory.
    """
    t, b, k = *x.shape, net.u.shape[1]
    out = np.empty((2, t, b, k), F32)
    az, ar, an, hz, hr, hn = np.empty((6, b, k), F32)
    half, at = F32(0.5), x.astype(np.intp)
    for side, steps in ((0, range(t)), (1, range(t - 1, -1, -1))):
        wz, wr, wn = (np.ascontiguousarray(net.w[side][:, i * k : i * k + k] * (half if i < 2 else F32(1))) for i in range(3))
        uz, ur, un = (np.ascontiguousarray(net.u[side][:, i * k : i * k + k] * half) for i in range(3))
        h = np.zeros((b, k), F32)
        for i in steps:
            for w, a in ((wz, az), (wr, ar), (wn, an)):
                np.take(w, at[i], axis=0, out=a, mode="clip")
            for u, v in ((uz, hz), (ur, hr), (un, hn)):
                np.matmul(h, u, out=v)
            az += hz
            np.tanh(az, out=az)  # z = (1 + az) / 2
            ar += hr
            np.tanh(ar, out=ar)  # r = (1 + ar) / 2
            an += hn
            ar *= hn
            an += ar
            np.tanh(an, out=an)
            new = out[side, i]
            np.subtract(h, an, out=new)
            new *= az
            new += h
            new += an
            new *= half
            h = new
    return out


def probabilities(net: Network, s: np.ndarray) -> np.ndarray:
    """(2, T, B, H) -> (C, T, B): each position's language probabilities."""
    _, t, b, k = s.shape
    p = net.v[:k].T @ s[0].reshape(-1, k).T
    p += net.v[k:].T @ s[1].reshape(-1, k).T
    p += net.c[:, None]
    p -= p.max(0)
    np.exp(p, out=p)
    p /= p.sum(0)
    return p.reshape(-1, t, b)


def gradients(net: Network, x: np.ndarray, y: np.ndarray, real: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Cross-entropy over the real positions of x (T, B) with labels y (B,), and its gradients by BPTT."""
    t, b, k = *x.shape, net.u.shape[1]
    s = states(net, x)
    p = probabilities(net, s)
    weight = (real / max(1, real.sum())).astype(F32)
    loss = float(-(np.log(p[y, :, np.arange(b)] + 1e-9) * weight.T).sum())
    p[y, :, np.arange(b)] -= 1
    p *= weight
    flat_d = p.reshape(len(p), -1)
    dv, dc = np.concatenate([s[i].reshape(-1, k).T @ flat_d.T for i in (0, 1)]), flat_d.sum(1)
    ds = [(flat_d.T @ net.v[i * k : i * k + k].T).reshape(t, b, k) for i in (0, 1)]
    dw, du = np.zeros_like(net.w), np.zeros_like(net.u)
    for side, steps in ((0, range(t - 1, -1, -1)), (1, range(t))):
        carry, u = np.zeros((b, k), F32), net.u[side]
        da_all, rows = np.empty((t, b, 3 * k), F32), x
        for i in steps:
            j = i - 1 if side == 0 else i + 1
            prev = s[side, j] if 0 <= j < t else np.zeros((b, k), F32)
            hu = prev @ u
            g, n = _gates(net.w[side][x[i]], hu.copy(), k)
            z, r = g[:, :k], g[:, k:]
            dh = ds[side][i] + carry
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (prev - n) * z * (1 - z)
            dr = dn * hu[:, 2 * k :] * r * (1 - r)
            da = da_all[i]
            da[:, :k], da[:, k : 2 * k], da[:, 2 * k :] = dz, dr, dn
            dhu = np.concatenate([dz, dr, dn * r], 1)
            du[side] += prev.T @ dhu
            carry = dh * z + dhu @ u.T
        order = np.argsort(rows.ravel(), kind="stable")
        sorted_x = rows.ravel()[order]
        first = np.flatnonzero(np.concatenate([[True], sorted_x[1:] != sorted_x[:-1]]))
        dw[side][sorted_x[first]] = np.add.reduceat(da_all.reshape(-1, 3 * k)[order], first, axis=0)
    return loss, [dw, du, dv, dc]


def windows(data: list[bytes], size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(T, B) bytes of all texts cut into windows, which of them are real (the last window is padded), and each window's text."""
    n = np.array([len(d) for d in data], np.int64)
    per = -(-n // size)
    flat = np.full(int(per.sum()) * size, 32, np.uint8)
    begin = (np.cumsum(per) - per) * size
    real = np.zeros(len(flat), bool)
    for d, a in zip(data, begin, strict=True):
        flat[a : a + len(d)] = np.frombuffer(d, np.uint8)
        real[a : a + len(d)] = True
    return np.ascontiguousarray(flat.reshape(-1, size).T), np.ascontiguousarray(real.reshape(-1, size).T), np.repeat(np.arange(len(data)), per)


def prepared(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


def train(texts: list[str], labels: list[str], hidden: int = HIDDEN, steps: int = STEPS, seed: int = 1) -> Network:
    """Adam on windows drawn evenly from the languages. Without labelled rows the network knows no language."""
    langs = sorted(set(labels))
    net = start(langs, hidden, seed)
    if len(langs) < 2:
        return net
    x, real, of = windows([prepared(t) for t in texts])
    y = np.array([langs.index(v) for v in labels])[of]
    rng, by_lang = np.random.default_rng(seed), [np.flatnonzero(y == i) for i in range(len(langs))]
    by_lang = [b if len(b) else np.arange(len(y)) for b in by_lang]
    m = [np.zeros_like(p) for p in net.params()]
    q = [np.zeros_like(p) for p in net.params()]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(b, max(1, BATCH // len(langs))) for b in by_lang])
        _, grads = gradients(net, x[:, pick], y[pick], real[:, pick])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for p, g, a, b in zip(net.params(), grads, m, q, strict=True):
            g = g * F32(min(1.0, 1.0 / (norm + 1e-9)))
            a += F32(0.1) * (g - a)
            b += F32(0.01) * (g * g - b)
            p -= F32(rate) * (a / F32(1 - 0.9**step)) / (np.sqrt(b / F32(1 - 0.99**step)) + F32(1e-6))
    return net


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def predict(net: Network, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and pooled probability of each text; `und` and 0 for texts without a letter."""
    score, pred = np.zeros(len(texts)), [UNDETERMINED] * len(texts)
    if not net.langs:
        return pred, score
    known = [i for i, t in enumerate(texts) if has_letter(t)]
    total, count = np.zeros((len(texts), len(net.langs))), np.zeros(len(texts))
    most = CHUNK_BYTES

    def label(data: list[bytes], owner: list[int]) -> None:
        x, real, of = windows(data)
        own = np.array(owner)[of]
        p = probabilities(net, states(net, x))
        p *= real
        p = p.sum(1)
        for k in range(len(p)):
            total[:, k] += np.bincount(own, p[k], len(texts))
        count[:] += np.bincount(own, real.sum(0), len(texts))

    data, owner, held = [], [], 0
    for i in known:
        d = prepared(texts[i])
        for a in range(0, len(d), most):  # a long text is labelled chunk by chunk; the sums run on
            piece = d[a : a + most]
            if held and held + len(piece) > most:
                label(data, owner)
                data, owner, held = [], [], 0
            data.append(piece)
            owner.append(i)
            held += len(piece)
    if data:
        label(data, owner)
    for i in known:
        mean = total[i] / max(count[i], 1)
        best = int(mean.argmax())
        pred[i], score[i] = net.langs[best], float(min(1.0, mean[best]))
    return pred, score


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", rows: int = SAMPLE_ROWS) -> Network:
    """Learns from at most `rows` rows with text and label, as many of each language (of the least hashes of id and text; all,
    if a language has fewer), of the LANGUAGES most frequent ones. Of a text longer than an even share of SAMPLE_CHARS, pieces
    of PIECE characters are taken evenly from its whole length. Repeated rows count once; null texts and labels do not.
    """
    named = docs.select(F.xxhash64(id_col, text_col).alias("h"), F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("lang"))
    named = named.where("lang IS NOT NULL AND text IS NOT NULL AND text <> ''")
    counts = named.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return train([], [])
    each = max(1, rows // len(counts))
    # hashes are even, so those of the first `each` rows lie below this share of all; a fifth and 30 more for chance
    last = [(r["lang"], min((1 << 63) - 1, int((1.2 * each + 30) / r["n"] * 2.0**64) - (1 << 63))) for r in counts]
    last = F.broadcast(docs.sparkSession.createDataFrame(last, "lang string, last long"))  # a row for each language
    share = max(PIECE, SAMPLE_CHARS // rows)
    pieces = f"transform(sequence(0, {share // PIECE - 1}), i -> substring(text, CAST(1 + i * (length(text) - {PIECE}) / {max(1, share // PIECE - 1)} AS INT), {PIECE}))"
    chosen = named.join(last, "lang").where("h <= last")
    chosen = chosen.groupBy("lang", "h").agg(F.first(F.expr(f"CASE WHEN length(text) <= {share} THEN array(text) ELSE {pieces} END")).alias("parts"))
    sample, taken = [], Counter()
    for lang, _, parts in sorted((r["lang"], r["h"], r["parts"]) for r in chosen.collect()):
        if taken[lang] < each:
            taken[lang] += 1
            sample.append((lang, parts))
    labelled = [(t, lang) for lang, parts in sample for t in parts]
    return train([t for t, _ in labelled], [v for _, v in labelled])


def language_id(docs: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score. Null texts and texts without a letter get `und` and 0, as do all if no language was learned.

    Whole texts are read, chunk by chunk if they are very long. Rows are independent: repeated rows, and rows with a null id,
    are predicted by their text; ties go to the language first in order. An empty table stays empty; other columns stay,
    clashing ones are replaced.
    """
    rest = [c for c in docs.columns if c not in ("lang_pred", "score")]
    broadcast = docs.sparkSession.sparkContext.broadcast(net)
    at = rest.index(text_col)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            pred, score = predict(broadcast.value, batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    schema = docs.select(*rest).schema.add("lang_pred", "string").add("score", "double")
    return docs.select(*rest).mapInArrow(label, schema)


HELD_OUT = "coalesce(crc32(CAST(doc_id AS STRING)) % 3 = 1, false)"


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the documents that are not held out, and predicts all of them."""
    docs = table(spark, sf_dir, "documents")
    net = fit(docs.where(f"NOT {HELD_OUT}"))
    rows = docs.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "text")
    return language_id(rows, net).select("doc_id", "held_out", "lang_pred", "score")
