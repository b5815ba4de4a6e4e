"""Language-model scoring: a gated recurrent network over words with a class-factored softmax.

Tokens are the words of a text and one end. Every token's count over all training texts is found by one
shuffle of the distinct words of each batch, packed by hash range; the reply goes back to the batch, whose
words wait in the shared folder as numbers. The most frequent words are symbols of the network, about four times
the cube root of the number of training words (`symbols_for`: 2 048 for 1.2e8 words, 65 536 for 1e13, whose weights are
9 MB); any other word is the symbol `rare` times its share among rare words, (c + 1) / (N + V + 1) over these.

A symbol is drawn by its class, then within it. Classes are runs of symbols by frequency with equal sums of the roots of
their probabilities, which makes the expected size of a token's class least: frequent symbols are classes of their own.

The network (HIDDEN gated units) is trained by truncated backpropagation on all training texts, once: shards of about
SHARD_WORDS words, dealt by a hash of id and text and written once, one bucket each. A shard has SLICES slices of its
texts; all shards train on their first slice from common weights, the weights are averaged, and so on to the last. To
score, the documents of a batch are laid out in lanes, which step together; a document's state starts at zero and is
carried from window to window to its end, so the score is that of the whole text.

Defined cases: a null or empty text is the end alone; rows with a null id are scored but not learned
from; repeated rows get equal scores; words never seen in training share one unseen word's chance;
without training texts N = V = 0 and the network keeps its first weights.
"""

from __future__ import annotations

import heapq
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm.language import remainder
from postloom.llm.store import partitions, saved, small_batches
from postloom.llm.words import _LIBC, chunks, released_group, word_hashes
from postloom.session import work_path

HIDDEN = 16
#: The least number of symbols. The last two symbols are the rare word and the end.
SYMBOLS = 1024
SHARD_WORDS, SHARDS, SLICES = 8_000_000, 6, 3
WINDOW, TRAIN_LANES = 16, 32
#: Steps are smaller during the first WARM windows of a slice, and fall to a tenth along it.
RATE, WARM = 0.01, 50
#: A large slice has more lanes, one for so many words up to MOST_LANES.
LANE_WORDS, MOST_LANES = 8192, 256
#: Weights are averaged in pieces of so many numbers.
PIECE = 16_384
LANES, SCORE_WINDOW, GROUP_BITS = 512, 128, 2
_LOG10 = np.log(10.0)
#: Words are counted by power of two of their count, up to this many.
LEVELS = 48

TOKENS = "chunk long, ids array<long>, keys array<long>, learn array<boolean>, held array<boolean>, sizes array<long>, words binary, places binary"


def _planes(x: np.ndarray) -> bytes:
    """Small numbers as compressed byte planes."""
    return zlib.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _from_planes(packed: bytes) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(packed), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)


def _tokenise(batches):
    """One row per batch: its distinct words, and each document's words as places among these."""
    chunk = TaskContext.get().partitionId() << 32
    for pdf in batches:
        texts = pdf["text"].tolist()
        for start, stop in chunks(texts):
            words, sizes = word_hashes(texts[start:stop])
            distinct, places = np.unique(words, return_inverse=True)
            part = pdf.iloc[start:stop]
            yield pd.DataFrame({
                "chunk": [chunk], "ids": [[None if pd.isna(i) else int(i) for i in part["doc_id"]]],
                "keys": [part["key"].to_numpy(np.int64)], "learn": [part["learn"].to_numpy(bool)], "held": [part["held"].to_numpy(bool)],
                "sizes": [sizes], "words": [distinct.tobytes()], "places": [_planes(places)],
            })
            chunk += 1


def _learned_counts(row) -> np.ndarray:
    learn = np.repeat(np.asarray(row.learn, bool), row.sizes)
    return np.bincount(_from_planes(row.places)[learn], minlength=len(row.words) // 8)


def _cuts(words: np.ndarray, buckets: int) -> np.ndarray:
    return np.searchsorted(((words >> np.uint64(48)) * np.uint64(buckets)) >> np.uint64(16), np.arange(buckets + 1, dtype=np.uint64))


def _emit(buckets: int):
    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples():
                words, times = np.frombuffer(row.words, np.uint64), _learned_counts(row).astype(np.uint32)
                cuts = _cuts(words, buckets)
                full = np.flatnonzero(np.diff(cuts)).tolist()
                low, high = words.astype(np.uint32), (words >> np.uint64(32)).astype(np.uint16)
                parts = [slice(cuts[b], cuts[b + 1]) for b in full]
                yield pd.DataFrame({
                    "chunk": row.chunk, "bucket": full, "low": [low[p].tobytes() for p in parts],
                    "high": [high[p].tobytes() for p in parts], "times": [times[p].tobytes() for p in parts],
                    "top": [(words[p] >> np.uint64(48)).astype(np.uint16).tobytes() for p in parts],
                })

    return run


COUNTED = "chunk long, bucket int, counts binary, head array<long>, head_counts array<long>, levels array<long>"


def _count(pdf: pd.DataFrame, most: int) -> pd.DataFrame:
    """Training counts of the words of one hash range, given back to every batch that has them; its `most` frequent words."""
    def joined(name, kind):
        return np.frombuffer(b"".join(pdf[name]), kind).astype(np.uint64)

    words = (joined("top", np.uint16) << np.uint64(48)) | (joined("high", np.uint16) << np.uint64(32)) | joined("low", np.uint32)
    times = joined("times", np.uint32).astype(np.float64)
    distinct, back = np.unique(words, return_inverse=True)
    totals = np.bincount(back, weights=times, minlength=len(distinct)).astype(np.int64)
    reply = totals[back]
    stops = np.cumsum([len(x) // 4 for x in pdf["low"]])
    starts = np.concatenate([[0], stops[:-1]])
    head = np.lexsort((distinct, -totals))[:most]
    head = head[totals[head] > 0]
    replies = [_planes(reply[a:b]) for a, b in zip(starts.tolist(), stops.tolist())]
    n = len(replies)
    return pd.DataFrame({
        "chunk": [-1, *pdf["chunk"]], "bucket": [pdf["bucket"].iat[0]] * (n + 1), "counts": [None, *replies],
        "head": [distinct[head].view(np.int64), *[None] * n], "head_counts": [totals[head], *[None] * n],
        "levels": [[int((totals >= 1 << i).sum()) for i in range(LEVELS)], *[None] * n],
    })


def symbols_for(n_words: int) -> int:
    """Number of symbols: the power of two nearest to four times the cube root of the number of training words."""
    return max(SYMBOLS, 1 << round(2 + np.log2(max(1, n_words)) / 3))


def class_edges(frequencies: np.ndarray) -> np.ndarray:
    """Where classes of symbols begin, and the end: about 0.7 times the root of the number of symbols of them."""
    root = np.sqrt(frequencies + 0.1)
    middle = np.cumsum(root) - root / 2
    of = np.floor(middle / root.sum() * max(8, round(0.7 * np.sqrt(len(root))))).astype(np.int64)
    return np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1, [len(root)]])


class Network:
    """Weights of the network; symbols are ordered by frequency, a class is a run of them."""

    def __init__(self, weights: dict[str, np.ndarray], edges: np.ndarray):
        self.w, self.edges = weights, edges

    @staticmethod
    def shapes(edges: np.ndarray) -> dict[str, tuple[int, ...]]:
        symbols, classes = int(edges[-1]), len(edges) - 1
        return {
            "E": (symbols, HIDDEN), "W": (HIDDEN, 3 * HIDDEN), "U": (HIDDEN, 3 * HIDDEN), "b": (3 * HIDDEN,),
            "C": (HIDDEN, classes), "c": (classes,), "O": (symbols, HIDDEN), "o": (symbols,),
        }

    @classmethod
    def first(cls, frequencies: np.ndarray) -> "Network":
        """Small random weights, with biases that give each symbol its frequency."""
        rng = np.random.Generator(np.random.PCG64(7))
        edges = class_edges(frequencies)
        w = {k: rng.normal(0, 0.1, shape) for k, shape in cls.shapes(edges).items()}
        w["b"][:] = 0
        p = frequencies + 0.1
        mass = np.add.reduceat(p, edges[:-1])
        w["c"] = np.log(mass / mass.sum())
        w["o"] = np.log(p / np.repeat(mass, np.diff(edges)))
        return cls(w, edges)

    def packed(self) -> bytes:
        return np.concatenate([self.w[k].ravel() for k in self.shapes(self.edges)]).astype(np.float32).tobytes()

    @classmethod
    def unpacked(cls, packed: bytes, edges: np.ndarray) -> "Network":
        return cls(cls.views(np.frombuffer(packed, np.float32), edges), edges)

    @classmethod
    def views(cls, flat: np.ndarray, edges: np.ndarray) -> dict[str, np.ndarray]:
        at, w = 0, {}
        for k, shape in cls.shapes(edges).items():
            n = int(np.prod(shape))
            w[k] = flat[at:at + n].reshape(shape)
            at += n
        return w


def by_class(edges: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """(order, class in that order, [(class, start, stop)] of classes with more than one symbol) of target symbols."""
    class_of = np.repeat(np.arange(len(edges) - 1, dtype=np.uint16 if len(edges) < 65536 else np.uint32), np.diff(edges))
    of = class_of[target]
    order = np.argsort(of, kind="stable")
    of = of[order]
    cuts = np.searchsorted(of, np.arange(len(edges)))
    wide = np.flatnonzero((np.diff(edges) > 1) & (np.diff(cuts) > 0)).tolist()
    return order, of, [(k, int(cuts[k]), int(cuts[k + 1])) for k in wide]


def lanes(sizes: np.ndarray, width: int) -> list[list[int]]:
    """Documents dealt to lanes, the longest first to the shortest lane; the longest lane first."""
    width = max(1, min(width, len(sizes)))
    heap, dealt = [(0, k) for k in range(width)], [[] for _ in range(width)]
    for i in np.argsort(-sizes, kind="stable").tolist():
        total, k = heapq.heappop(heap)
        dealt[k].append(i)
        heapq.heappush(heap, (total + int(sizes[i]), k))
    return [dealt[k] for _, k in sorted(heap, key=lambda lane: -lane[0])]


def layout(symbols: np.ndarray, sizes: np.ndarray, width: int, end: int):
    """(before, target, fresh, doc), each of shape (steps, lanes): documents one after another, -1 where none is."""
    stops = np.cumsum(sizes)
    dealt = lanes(sizes, width)
    steps = max(sum(int(sizes[i]) for i in lane) for lane in dealt)
    target = np.zeros((steps, len(dealt)), np.int32)
    doc = np.full((steps, len(dealt)), -1, np.int32)
    before = np.full((steps, len(dealt)), end, np.int32)
    fresh = np.zeros((steps, len(dealt)), bool)
    for k, lane in enumerate(dealt):
        at = 0
        for i in lane:
            n = int(sizes[i])
            own = symbols[stops[i] - n:stops[i]]
            target[at:at + n, k], doc[at:at + n, k] = own, i
            before[at + 1:at + n, k] = own[:-1]
            fresh[at, k] = True
            at += n
    return before, target, fresh, doc


def running(doc: np.ndarray, start: int) -> int:
    """How many lanes go on at a step: those before the first that has ended."""
    return int((doc[start] >= 0).sum())


def log_likelihood(net: Network, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Natural log probability of each document's symbols; documents follow one another in `symbols`."""
    out = np.zeros(len(sizes))
    if not len(sizes):
        return out
    long = sizes > 2 * max(1, len(symbols) // LANES)
    if long.any() and not long.all():  # few long documents would keep many lanes waiting
        of = np.repeat(long, sizes)
        for part in (long, ~long):
            out[part] = log_likelihood(net, symbols[of if part is long else ~of], sizes[part])
        return out
    w, edges = net.w, net.edges
    before, target, fresh, doc = layout(symbols, sizes, LANES, len(w["E"]) - 1)
    # lanes and tokens are the last axis: every step works on contiguous rows
    given, up = (np.ascontiguousarray(x.T, np.float32) for x in (w["E"] @ w["W"] + w["b"], w["U"]))
    given[: 2 * HIDDEN] *= 0.5
    up[: 2 * HIDDEN] *= 0.5
    h = np.zeros((HIDDEN, before.shape[1]), np.float32)
    for start in range(0, len(before), SCORE_WINDOW):
        width = running(doc, start)
        h, part = h[:, :width], (slice(start, start + SCORE_WINDOW), slice(0, width))
        live = doc[part] >= 0
        g = given.take(before[part].ravel(), axis=1).reshape(3 * HIDDEN, len(live), width)
        states = np.empty((len(live), HIDDEN, width), np.float32)
        some = fresh[part].any(axis=1).tolist()
        for j in range(len(live)):
            if some[j]:
                h = h * ~fresh[start + j, :width]
            u = up @ h
            gates, new = u[: 2 * HIDDEN], u[2 * HIDDEN:]
            gates += g[: 2 * HIDDEN, j]
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            new *= gates[HIDDEN:]
            new += g[2 * HIDDEN:, j]
            np.tanh(new, out=new)
            new -= h
            new *= gates[:HIDDEN]
            h = np.add(h, new, out=states[j])
        tokens = np.flatnonzero(live)
        order, of, wide = by_class(edges, target[part].ravel()[tokens])
        tokens = tokens[order]
        t, d = target[part].ravel()[tokens], doc[part].ravel()[tokens]
        s = states.transpose(1, 0, 2).reshape(HIDDEN, -1).take(tokens, axis=1)
        logits = w["C"].T @ s
        logits += w["c"][:, None]
        found = logits[of, np.arange(len(t))].astype(np.float64)
        np.exp(logits, out=logits)
        found -= np.log(logits.sum(axis=0))
        for k, lo, hi in wide:
            logits = w["O"][edges[k]:edges[k + 1]] @ s[:, lo:hi]
            logits += w["o"][edges[k]:edges[k + 1], None]
            found[lo:hi] += logits[t[lo:hi] - edges[k], np.arange(hi - lo)]
            np.exp(logits, out=logits)
            found[lo:hi] -= np.log(logits.sum(axis=0))
        out += np.bincount(d, weights=found, minlength=len(sizes))
    return out


def _softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=1, keepdims=True)
    return x


def train_window(w: dict, edges: np.ndarray, h: np.ndarray, before, target, fresh, live, grad: dict | None = None):
    """(loss, gradients, last state) of one window; the state that enters it is a constant."""
    H, (steps, width) = HIDDEN, before.shape
    kind = w["E"].dtype
    grad = {k: np.empty_like(v) for k, v in w.items()} if grad is None else grad
    given = w["E"].take(before.ravel(), axis=0)
    # lanes are the last axis inside the window
    g = np.matmul(w["W"].T, given.reshape(steps, width, H).transpose(0, 2, 1))
    g += w["b"][:, None]
    prev, un, n, states = (np.empty((steps, H, width), kind) for _ in range(4))
    gates = g[:, : 2 * H]
    kept, some = (~fresh).astype(kind), fresh.any(axis=1).tolist()
    h, up = np.ascontiguousarray(h.T), np.ascontiguousarray(w["U"].T)
    for j in range(steps):
        np.multiply(h, kept[j] if some[j] else 1, out=prev[j])
        u = up @ prev[j]
        a = gates[j]
        a += u[: 2 * H]
        a *= 0.5
        np.tanh(a, out=a)
        a += 1
        a *= 0.5
        un[j] = u[2 * H:]
        x = a[H:] * un[j]
        x += g[j, 2 * H:]
        np.tanh(x, out=n[j])
        h = n[j] - prev[j]
        h *= a[:H]
        h += prev[j]
        states[j] = h
    z, r = gates[:, :H], gates[:, H:]
    # tokens sorted by class, the second softmax class by class
    tokens = np.flatnonzero(live)
    t = target.ravel()[tokens]
    order, of, wide = by_class(edges, t)
    tokens, t = tokens[order], t[order]
    s = states.transpose(0, 2, 1).reshape(-1, H).take(tokens, axis=0)
    count, rows = max(1, len(t)), np.arange(len(t))
    p = _softmax(s @ w["C"] + w["c"])
    loss = -np.log(p[rows, of]).sum()
    p[rows, of] -= 1
    grad["C"][:], grad["c"][:] = s.T @ p, p.sum(axis=0)
    ds = p @ w["C"].T
    grad["O"][:] = grad["o"][:] = 0
    for k, lo, hi in wide:
        here, own = s[lo:hi], slice(edges[k], edges[k + 1])
        q, at = _softmax(here @ w["O"][own].T + w["o"][own]), (rows[: hi - lo], t[lo:hi] - edges[k])
        loss -= np.log(q[at]).sum()
        q[at] -= 1
        np.matmul(q.T, here, out=grad["O"][own])
        np.sum(q, axis=0, out=grad["o"][own])
        ds[lo:hi] += q @ w["O"][own]
    for k in ("C", "c", "O", "o"):
        grad[k] /= count
    back = np.zeros((steps * width, H), kind)
    back[tokens] = ds / count
    back = np.ascontiguousarray(back.reshape(steps, width, H).transpose(0, 2, 1))
    # gradients of the gates for each unit of dh, or of dn
    by_n, by_z, by_r, stay = z * (1 - n * n), (n - prev) * z * (1 - z), un * r * (1 - r), 1 - z
    du, dn = np.empty_like(g), np.empty_like(n)
    dh = np.zeros_like(h)
    for j in range(steps - 1, -1, -1):
        dh += back[j]
        np.multiply(dh, by_n[j], out=dn[j])
        np.multiply(dh, by_z[j], out=du[j, :H])
        np.multiply(dn[j], by_r[j], out=du[j, H:2 * H])
        np.multiply(dn[j], r[j], out=du[j, 2 * H:])
        dh *= stay[j]
        dh += w["U"] @ du[j]
        if some[j]:
            dh *= kept[j]
    grad["U"][:] = np.matmul(prev, du.transpose(0, 2, 1)).sum(axis=0)
    du[:, 2 * H:] = dn
    dg = du.transpose(0, 2, 1).reshape(-1, 3 * H)
    grad["W"][:] = given.T @ dg
    grad["b"][:] = dg.sum(axis=0)
    order = np.argsort(before, axis=None, kind="stable")
    known = before.ravel()[order]
    first = np.flatnonzero(np.concatenate([[True], known[1:] != known[:-1]]))
    grad["E"][:] = 0
    grad["E"][known[first]] = np.add.reduceat((dg @ w["W"].T).take(order, axis=0), first, axis=0)
    return loss / count, grad, np.ascontiguousarray(h.T)


def train(net: Network, symbols: np.ndarray, sizes: np.ndarray) -> Network:
    """One pass of Adam over the documents, window by window."""
    if hasattr(_LIBC, "mallopt"):  # arrays of a window come from the heap again and again, not from fresh pages
        _LIBC.mallopt(-3, 1 << 28)
        _LIBC.mallopt(-1, 1 << 28)
    if not len(sizes):
        return net
    known, edges = len(net.w["E"]), net.edges
    flat = np.frombuffer(net.packed(), np.float32).copy()
    grads, m, v, work = (np.zeros_like(flat) for _ in range(4))
    w, grad = Network.views(flat, edges), Network.views(grads, edges)
    width = min(MOST_LANES, max(TRAIN_LANES, len(symbols) // LANE_WORDS))
    before, target, fresh, doc = layout(symbols, sizes, width, known - 1)
    h = np.zeros((before.shape[1], HIDDEN), np.float32)
    for number, start in enumerate(range(0, len(before), WINDOW), 1):
        width = running(doc, start)
        h, part = h[:width], (slice(start, start + WINDOW), slice(0, width))
        _, _, h = train_window(w, edges, h, before[part], target[part], fresh[part], doc[part] >= 0, grad)
        grads *= np.float32(min(1.0, 1.0 / max(np.sqrt(grads @ grads), 1e-12)))
        m *= np.float32(0.9)
        np.multiply(grads, np.float32(0.1), out=work)
        m += work
        v *= np.float32(0.999)
        grads *= grads
        grads *= np.float32(0.001)
        v += grads
        np.multiply(v, np.float32(1 / (1 - 0.999**number)), out=work)
        np.sqrt(work, out=work)
        work += np.float32(1e-8)
        np.divide(m, work, out=work)
        work *= np.float32(RATE * min(1.0, number / WARM) * (1 - 0.9 * start / len(before)) / (1 - 0.9**number))
        flat -= work
    return Network(w, edges)


class Vocabulary:
    """The most frequent training words by rank; `rare` and `end` are the last two symbols."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, n_words: int, n_docs: int, distinct: int):
        self.size = symbols_for(n_words)
        rank = np.argsort(words)
        self.words, self.symbols = words[rank], rank
        rare = n_words - int(counts.sum())
        self.rare_total = rare + max(0, distinct - len(words)) + 1
        self.frequencies = np.zeros(self.size)
        self.frequencies[: len(words)] = counts
        self.frequencies[-2:] = rare, n_docs
        self.tokens, self.known = n_words + n_docs, distinct + (n_docs > 0)
        self.ends = n_docs

    def encode(self, words: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.full(len(words), self.size - 2, np.int64)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, self.symbols[at], self.size - 2)


    def with_ends(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return np.insert(symbols, np.cumsum(sizes), self.size - 1)


ENCODED = "shard long, slice int, key long, symbols binary"


def _encode(vocabulary: Vocabulary, labels: np.ndarray):
    """The symbols of every training text, with its shard and slice."""
    kind, shards = np.uint16 if vocabulary.size <= 1 << 16 else np.uint32, len(labels)

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples():
                symbols = vocabulary.encode(np.frombuffer(row.words, np.uint64)).astype(kind)[_from_planes(row.places)]
                stops, keys = np.cumsum(row.sizes), np.asarray(row.keys, np.int64)
                own = np.flatnonzero(np.asarray(row.learn, bool)).tolist()
                yield pd.DataFrame({
                    "shard": labels[keys[own] % shards], "slice": (keys[own] // shards % SLICES).astype(np.int32), "key": keys[own],
                    "symbols": [symbols[stops[i] - row.sizes[i]:stops[i]].tobytes() for i in own],
                })

    return run


def _shard_labels(spark: SparkSession, shards: int) -> np.ndarray:
    """A number for each shard, such that Spark's hash puts each into a bucket of its own."""
    numbers = spark.range(shards * 64).select("id", F.pmod(F.hash("id"), F.lit(shards)).alias("bucket"))
    found = dict(numbers.groupBy("bucket").agg(F.min("id")).collect())  # a row per shard
    return np.array([found.get(k, k) for k in range(shards)], np.int64)


def _train_shard(packed: bytes, vocabulary: Vocabulary):
    kind, edges = np.uint16 if vocabulary.size <= 1 << 16 else np.uint32, class_edges(vocabulary.frequencies)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", kind="stable")
        sizes = pdf["symbols"].str.len().to_numpy(np.int64) // np.dtype(kind).itemsize
        symbols = np.frombuffer(b"".join(pdf["symbols"]), kind)
        net = train(Network.unpacked(packed, edges), vocabulary.with_ends(symbols, sizes), sizes + 1)
        flat = np.frombuffer(net.packed(), np.float32)
        cuts = range(0, len(flat), PIECE)
        return pd.DataFrame({
            "piece": range(len(cuts)), "shard": pdf["shard"].iat[0], "tokens": int(sizes.sum() + len(sizes)),
            "weights": [flat[a:a + PIECE].tobytes() for a in cuts],
        })

    return run


def _average(pdf: pd.DataFrame) -> pd.DataFrame:
    """One piece of the weights of all shards, each by its share of the tokens."""
    pdf = pdf.sort_values("shard")
    total, tokens = 0.0, float(pdf["tokens"].sum())
    for weights, n in zip(pdf["weights"], pdf["tokens"]):
        total = total + np.frombuffer(weights, np.float32) * (n / tokens)
    return pd.DataFrame({"piece": [pdf["piece"].iat[0]], "weights": [total.astype(np.float32).tobytes()]})


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(net_packed: bytes, vocabulary: Vocabulary):
    """Scores of the batches of one group, whose documents share lanes."""
    edges = class_edges(vocabulary.frequencies)

    def run(tokens: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        net, done, all_symbols, all_sizes = Network.unpacked(net_packed, edges), [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        replies = dict(iter(replies.sort_values("bucket").groupby("chunk")))
        scale = np.log10(vocabulary.tokens + vocabulary.known + 1)
        for row in tokens.sort_values("chunk").itertuples():
            sizes, places = np.asarray(row.sizes, np.int64), _from_planes(row.places)
            words = np.frombuffer(row.words, np.uint64)
            counts = np.concatenate([np.zeros(0, np.int64), *(_from_planes(c) for c in replies[row.chunk]["counts"])]) if len(words) else np.zeros(0, np.int64)
            doc = np.repeat(np.arange(len(sizes)), sizes)

            def total(per_word, at_end):
                return np.bincount(doc, weights=per_word[places], minlength=len(sizes)) + at_end

            base = total(np.log10(counts + 1.0) - scale, np.log10(vocabulary.ends + 1.0) - scale)
            known = total((counts > 0).astype(float), float(vocabulary.ends > 0))
            symbols = vocabulary.encode(words)
            rare = np.where(symbols == vocabulary.size - 2, np.log((counts + 1.0) / vocabulary.rare_total), 0.0)
            all_symbols.append(vocabulary.with_ends(symbols[places], sizes))
            all_sizes.append(sizes + 1)
            done.append(pd.DataFrame({
                "doc_id": pd.array(list(row.ids), "Int64"), "held_out": np.asarray(row.held, bool), "n_tokens": sizes + 1,
                "n_known": known.astype(np.int64), "train_tokens": vocabulary.tokens, "base_score": base, "score": total(rare, 0.0),
            }))
        if not done:
            return pd.DataFrame({c.split()[0]: [] for c in SCORED.split(", ")})
        found = pd.concat(done, ignore_index=True)
        found["score"] = (found["score"] + log_likelihood(net, np.concatenate(all_symbols), np.concatenate(all_sizes))) / _LOG10
        return found

    return run


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", learn=None, held=None) -> DataFrame:
    """One row per row of `docs` with the columns of SCORED.

    `learn` says which rows are training texts (default: those with an id), `held` fills held_out.
    """
    spark = docs.sparkSession
    small_batches(spark)
    buckets = 2 * partitions(spark)
    known = F.col(id_col).isNotNull()
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"),
        F.xxhash64(id_col, text_col).alias("key"),
        (known if learn is None else F.coalesce(learn, F.lit(False)) & known).alias("learn"),
        (F.lit(False) if held is None else F.coalesce(held, F.lit(False))).alias("held"),
    )
    tokens = saved(rows.mapInPandas(_tokenise, TOKENS), "tokens")
    learned = tokens.select(F.explode(F.arrays_zip("learn", "sizes")).alias("t")).where("t.learn")
    n_docs, n_words = learned.agg(F.count("*"), F.coalesce(F.sum("t.sizes"), F.lit(0))).first()
    most = symbols_for(n_words) - 2
    emitted = tokens.mapInPandas(_emit(buckets), "chunk long, bucket int, low binary, high binary, times binary, top binary")
    counted = saved(emitted.groupBy("bucket").applyInPandas(lambda pdf: _count(pdf, most), COUNTED), "counts")
    heads = counted.where("chunk < 0")
    levels = heads.select(F.posexplode("levels").alias("level", "n")).groupBy("level").agg(F.sum("n").alias("n"))
    levels = dict(levels.collect())  # LEVELS rows
    distinct = levels.get(0, 0)
    # the highest power of two that still leaves a full vocabulary; rarer words of the heads are not unpacked
    least = 1 << max((i for i, n in levels.items() if n >= most), default=0)
    often = F.filter(F.arrays_zip("head", "head_counts"), lambda h: h["head_counts"] >= least)
    top = heads.select(F.explode(often).alias("h")).select("h.*")
    top = top.orderBy(F.col("head_counts").desc(), "head").limit(most).collect()
    vocabulary = Vocabulary(
        np.array([r[0] for r in top], np.int64).view(np.uint64), np.array([r[1] for r in top], np.int64), n_words, n_docs, distinct
    )
    net = Network.first(vocabulary.frequencies).packed()
    if n_docs:
        labels = _shard_labels(spark, max(SHARDS, -(-n_words // SHARD_WORDS)))
        name = f"shards_{uuid.uuid4().hex}"
        encoded = tokens.mapInPandas(_encode(vocabulary, labels), ENCODED).repartition(len(labels), "shard")
        (
            encoded.write.format("parquet").option("path", work_path(spark, "shards"))
            .partitionBy("slice").bucketBy(len(labels), "shard").saveAsTable(name)
        )
        for k in range(SLICES):
            texts = spark.table(name).where(F.col("slice") == k)
            trained = texts.groupBy("shard").applyInPandas(released_group(_train_shard(net, vocabulary)), "piece int, shard long, tokens long, weights binary")
            pieces = trained.groupBy("piece").applyInPandas(_average, "piece int, weights binary").orderBy("piece").collect()
            net = b"".join(x["weights"] for x in pieces) or net
        spark.sql(f"DROP TABLE {name}")
    replies = counted.where("chunk >= 0").select("chunk", "bucket", "counts")
    # neighbouring batches of a task are scored together: a long document then keeps fewer lanes waiting
    group = F.shiftright("chunk", GROUP_BITS).alias("group")
    tokens, replies = tokens.select("*", group), replies.select("*", group)
    return tokens.groupBy("group").cogroup(replies.groupBy("group")).applyInPandas(released_group(_score(net, vocabulary)), SCORED)


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_documents(docs, learn=remainder(7) != 2, held=remainder(7) == 2)
