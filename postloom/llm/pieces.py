"""Sampled subword encoding: Gumbel top-k segmentations without replacement.

The lattice of a text has every way to write it in pieces of a public vocabulary. A piece has weight
1 / (rank + OFFSET), a segmentation the product of its pieces' weights, normalised over the lattice.
For each row a perturbed A-star search emits the k segmentations with the largest log probability plus
Gumbel noise, which is a sample of k without replacement. A node of the search is a prefix of pieces with
some next pieces excluded; its bound is the largest perturbed value below it, drawn given the bound of
its parent, so the best node on the frontier holds the next segmentation. Opening a node draws the rest of
its segmentation from the lattice and leaves a sibling node at every step. The bound of the best node
left after k is the threshold from which inclusion scores follow: 1 - exp(-exp(log p - threshold)).

All randomness is a hash of the row's key and the place in the text, so a rerun, another batch or a
lost executor changes nothing. Pieces never cross the start of a run of spaces, so equal units of text
(a run of spaces and what follows) share one lattice, which is built once per batch for all of them.

A text is written after one space, spaces as U+2581. Characters without a piece, and U+2581 itself,
are written in byte pieces, so decoding is exact for every text.

Defined cases: a null or empty text is one space and so has one segmentation; a row whose lattice has
fewer than k segmentations gives all of them, with inclusion 1 where nothing is left; equal keys draw
equal noise; a null id is the key 0; lone surrogates are written as three bytes each; an empty table
gives no rows. A word of any length is handled, its lattice growing with its length only.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm.store import small_batches
from postloom.llm.words import chunks, mix, release, released

OFFSET, SAMPLES = 10.0, 2
CHUNK = 1_000_000
MARK = 0x2581
_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_MISS = -1


def default_model() -> str:
    """Path of the public vocabulary that is used unless another is named."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """A vocabulary as a trie over code points, kept in a hash table of (node, code point) → node."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(self.size)]
        usual = [i for i in range(self.size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.byte_id = np.full(256, -1, np.int64)
        for i in range(self.size):
            if sp.is_byte(i):
                self.byte_id[int(self.text[i][3:5], 16)] = i
        rank = np.array([min(-sp.get_score(i), float(self.size)) for i in range(self.size)])
        self.weights = np.append(-np.log(np.maximum(rank, 0) + OFFSET), 0.0)
        self.weights[self.byte_id[self.byte_id >= 0]] = 0.0
        children: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        for i in usual:
            node = 0
            for ch in self.text[i]:
                node = children.setdefault((node, ord(ch)), len(children) + 1)
            ends[node] = i
        self.end = np.full(len(children) + 1, _MISS, np.int32)
        self.end[list(ends)] = list(ends.values())
        singles = {ord(self.text[i]) for i in usual if len(self.text[i]) == 1}
        self.code_hash = mix(np.arange(1, 0x110001, dtype=np.uint64))
        self.single = np.zeros(0x110000, bool)
        self.single[list(singles)] = True
        keys = np.array([(n << 21) | c for n, c in children], np.uint64)
        self.bits = 64 - max(18, int(np.ceil(np.log2(len(keys) * 8))))
        self.keys, self.nodes = keys, np.array(list(children.values()), np.int32)
        slot = (keys * _K[0]) >> np.uint64(self.bits)
        self.table = np.full((4, 1 << (64 - self.bits)), -1, np.int32)
        left = np.arange(len(keys))
        for level in range(4):
            _, lead = np.unique(slot[left], return_index=True)
            self.table[level, slot[left[lead]]] = left[lead]
            left = np.delete(left, lead)
        if len(left):
            raise ValueError("vocabulary too large for the piece table")
        byte_text = {i: bytes([b]) for b, i in enumerate(self.byte_id.tolist()) if i >= 0}
        self.raw = [byte_text.get(i, t.replace("▁", " ").encode("utf-8")) for i, t in enumerate(self.text)]

    def usual_weight(self, piece: np.ndarray) -> np.ndarray:
        """Log weights; the only way to write a character counts 1."""
        return self.weights[np.minimum(piece, self.size)]

    def step(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The child of each node by a code point, or _MISS."""
        key = (node.astype(np.uint64) << np.uint64(21)) | code.astype(np.uint64)
        slot = (key * _K[0]) >> np.uint64(self.bits)
        out = np.full(len(key), _MISS, np.int32)
        open_ = np.arange(len(key))
        for level in range(4):
            at = self.table[level, slot[open_]]
            open_, at = open_[at >= 0], at[at >= 0]
            hit = self.keys[at] == key[open_]
            out[open_[hit]] = self.nodes[at[hit]]
            open_ = open_[~hit]
            if not len(open_):
                break
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of a whole segmentation."""
        return b"".join(map(self.raw.__getitem__, ids.tolist()))[1:].decode("utf-8", "surrogatepass")


class Lattices:
    """The lattices of distinct units: edges sorted by state, the likeliest first; -1 is the end."""

    def __init__(self, pieces: Pieces, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        offset = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else np.zeros(0, np.int64)
        n = int(lengths.sum())
        inside = np.arange(n, dtype=np.int32) - np.repeat(offset, lengths).astype(np.int32)
        chars = codes[np.repeat(starts, lengths) + inside]
        left = np.repeat(lengths, lengths).astype(np.int32) - inside
        forced = ~pieces.single[chars]
        at, node, found, deep = np.flatnonzero(~forced).astype(np.int32), np.zeros(n, np.int32)[~forced], [], 0
        while len(at):
            node = pieces.step(node, chars[at + deep])
            alive = node >= 0
            at, node, deep = at[alive], node[alive], deep + 1
            piece = pieces.end[node]
            ends = piece >= 0
            found.append((at[ends], deep, piece[ends]))
            go = left[at] > deep
            at, node = at[go], node[go]
        lone = np.flatnonzero(forced).astype(np.int32)
        # a character without a piece is a unit: its byte piece, or a number that stands for several
        code = chars[lone]
        number = np.where(code < 128, pieces.byte_id[np.minimum(code, 127)], pieces.size + code).astype(np.int32)
        found.append((lone, 1, number))
        self.fan = np.zeros(n, np.int32)
        for at, _, _ in found:
            self.fan[at] += 1
        self.first = np.concatenate([[0], np.cumsum(self.fan)]).astype(np.int32)
        self.state, length, self.piece = (np.empty(int(self.first[-1]), np.int32) for _ in range(3))
        fill = self.first[:-1].copy()
        for at, deep, piece in reversed(found):  # of a state's pieces the longest first, mostly the likeliest
            place = fill[at]
            self.state[place], length[place], self.piece[place] = at, deep, piece
            fill[at] = place + 1
        state, piece = self.state, self.piece
        self.to = np.where(left[state] == length, np.int32(-1), state + length)
        # total weight below every state, from the ends of the units backwards
        rest = np.minimum(left[state], 65535)
        order = np.argsort(rest.astype(np.uint16) if rest.max(initial=0) < 65535 else left[state], kind="stable")
        weight, from_, to = pieces.usual_weight(piece)[order], state[order], self.to[order]
        below, mass = np.zeros(n + 1), np.empty(len(state))
        cuts = np.concatenate([[0], np.cumsum(np.bincount(left[state], minlength=1)[1:])])
        new = np.ones(len(state), bool)
        new[1:] = from_[1:] != from_[:-1]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if a == b:
                continue
            part, first = weight[a:b] + below[to[a:b]], np.flatnonzero(new[a:b])
            high = np.maximum.reduceat(part, first)
            group = np.cumsum(new[a:b]) - 1
            part -= high[group]
            total = np.log(np.add.reduceat(np.exp(part), first))
            below[from_[a:b][first]] = high + total
            mass[a:b] = part - total[group]
        self.logp = np.empty(len(state))
        self.logp[order] = mass
        del order, weight, from_, to, mass, rest
        # the chance of a piece or one before it, for drawing the next piece of a state
        run = np.concatenate([[0.0], np.cumsum(np.exp(self.logp))])
        self.upto = (run[1:] - run[self.first[state]]).astype(np.float32)
        last = self.first[1:] - 1
        self.upto[last[last >= 0]] = 2.0
        self.root = offset


def _scaled(n: int, which: int) -> np.uint64:
    return np.uint64(n * int(_K[which]) & 0xFFFFFFFFFFFFFFFF)


def uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from seeds that are mixed already, apart from a step."""
    x = (x ^ (x >> np.uint64(32))) * _K[3]
    x ^= x >> np.uint64(29)
    return (((x * _K[0]) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def draw(lattices: Lattices, state: np.ndarray, noise: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edges, counts): a path drawn from every state to the end of its unit, one after another.

    `order` lists the places of `state` so that neighbours in the tables are drawn together.
    """
    counts, steps = np.zeros(len(state), np.int64), []
    who, step = order[state[order] >= 0], 0
    at, seed = state[who], noise[who]
    while len(who):
        u = uniform(seed + _scaled(step, 1))
        edge = lattices.first[at]
        more = np.flatnonzero(u > lattices.upto[edge])
        while len(more):
            edge[more] += 1
            more = more[u[more] > lattices.upto[edge[more]]]
        steps.append((who, edge))
        counts[who] += 1
        at = lattices.to[edge]
        go = at >= 0
        who, at, seed, step = who[go], at[go], seed[go], step + 1
    begin = np.cumsum(counts) - counts
    edges = np.empty(int(counts.sum()), np.int64)
    for k, (who, edge) in enumerate(steps):
        edges[begin[who] + k] = edge
    return edges, counts


def gumbel_below(log_mass: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel variables with locations log_mass, given that they are below bound."""
    with np.errstate(divide="ignore"):
        return -np.logaddexp(-bound, np.log(-np.log(u)) - log_mass)


class Batch:
    """The texts of one batch cut into units, with the lattices of the distinct units."""

    def __init__(self, pieces: Pieces, texts: list[str | None], keys: np.ndarray):
        self.pieces, self.keys = pieces, keys
        parts = [" " + (t or "") for t in texts]
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.int32)
        bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        space = codes == 32
        codes = np.where(space, np.int32(MARK), np.where(codes == MARK, np.int32(0x10FFFF), codes))
        forced = ~pieces.single[codes]
        begins = np.zeros(len(codes), bool)
        begins[bounds[:-1]] = True
        begins[1:] |= space[1:] & ~space[:-1]
        begins |= forced
        begins[1:] |= forced[:-1]
        starts = np.flatnonzero(begins)
        lengths = np.diff(np.append(starts, len(codes)))
        self.units = np.searchsorted(starts, bounds)
        self.doc = np.repeat(np.arange(len(parts)), np.diff(self.units))
        inside = np.arange(len(codes), dtype=np.int32) - np.repeat(starts.astype(np.int32), lengths)
        power = np.cumprod(np.full(int(lengths.max(initial=0)) + 1, _K[2], np.uint64))
        value = pieces.code_hash[codes] * power[inside]
        name = mix(np.add.reduceat(value, starts) + lengths.astype(np.uint64)) if len(starts) else np.zeros(0, np.uint64)
        # units by name: equal ones share a lattice, and neighbours in the tables are drawn together
        self.order = np.argsort(name, kind="stable")
        ordered = name[self.order]
        new = np.ones(len(ordered), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        lead, kind = self.order[new], np.empty(len(ordered), np.int64)
        kind[self.order] = np.cumsum(new) - 1
        del inside, value, power, name, ordered, new, space, forced, begins
        self.lattices = Lattices(pieces, codes, starts[lead], lengths[lead])
        self.root = self.lattices.root[kind]
        number = np.arange(len(starts)) - np.repeat(self.units[:-1], np.diff(self.units))
        self.noise = mix(keys[self.doc] + number.astype(np.uint64) * _K[2])

    def bytes_of(self, piece: int) -> list[int]:
        code = piece - self.pieces.size
        ch = "▁" if code == 0x10FFFF else chr(code)
        return self.pieces.byte_id[list(ch.encode("utf-8", "surrogatepass"))].tolist()

    def ids(self, edges: np.ndarray) -> np.ndarray:
        found = self.lattices.piece[edges]
        if (found >= self.pieces.size).any():
            parts = [[p] if p < self.pieces.size else self.bytes_of(p) for p in found.tolist()]
            found = np.array([i for part in parts for i in part], np.int64)
        return found.astype("<i4")

    def samples(self, k: int):
        """For every text up to k tuples (edges, log p, perturbed) by falling value, and the threshold."""
        lat, n = self.lattices, len(self.keys)
        top = -np.log(-np.log(uniform(self.keys ^ _K[3])))  # all segmentations together have mass 1
        frontier = [[(-g, 0, None, 0, ())] for g in top.tolist()]
        paths: list[list] = [[] for _ in range(n)]
        for number in range(k):
            popped = [heapq.heappop(f) if f else None for f in frontier]
            state = self.root.copy()
            skip = np.zeros(len(state), bool)
            kept = [np.zeros(0, np.int64)] * n
            for d, node in enumerate(popped):
                if node is None:
                    skip[self.units[d]:self.units[d + 1]] = True
                elif node[2] is not None:
                    edges, unit, at = node[2][0], node[2][1], node[3]
                    row = int(lat.to[edges[at - 1]]) if at and unit[at - 1] == unit[at] else int(self.root[unit[at]])
                    choices = [e for e in range(int(lat.first[row]), int(lat.first[row + 1])) if e not in node[4]]
                    weight = np.cumsum(np.exp(lat.logp[choices]))
                    u = uniform(self.keys[d:d + 1] + _scaled(number, 3) + np.uint64(at))[0]
                    chosen = choices[min(int(np.searchsorted(weight, u * weight[-1])), len(choices) - 1)]
                    kept[d] = np.append(edges[:at], chosen)
                    skip[self.units[d]:unit[at]] = True
                    state[unit[at]] = lat.to[chosen]
            live = np.flatnonzero(~skip)
            rank = np.cumsum(~skip) - 1
            drawn, counts = draw(lat, state[live], mix(self.noise[live] + _scaled(number, 1)), rank[self.order[~skip[self.order]]])
            unit_of = np.repeat(live, counts)
            cut = np.searchsorted(unit_of, self.units)
            logp = lat.logp[drawn]
            for d, node in enumerate(popped):
                if node is None:
                    continue
                tail = slice(cut[d], cut[d + 1])
                edges, bound, fork = np.concatenate([kept[d], drawn[tail]]), -node[0], len(kept[d]) - 1
                unit = unit_of[tail] if node[2] is None else np.concatenate([node[2][1][: fork + 1], unit_of[tail]])
                steps = logp[tail] if node[2] is None else lat.logp[edges]
                before = np.cumsum(steps)
                paths[d].append((edges, float(before[-1]), bound))
                # a sibling at every step: what the other next pieces hold
                from_ = max(fork, 0)
                rest = -np.expm1(steps[from_:])
                if fork >= 0:
                    rest[0] -= np.exp(lat.logp[list(node[4])]).sum()
                single = lat.fan[lat.state[edges[from_:]]]
                taken = np.ones(len(rest), np.int64)
                if fork >= 0:
                    taken[0] += len(node[4])
                with np.errstate(divide="ignore"):
                    mass = np.where(single > taken, np.log(np.maximum(rest, 1e-300)), -np.inf) + before[from_:] - steps[from_:]
                u = uniform(np.arange(from_, len(edges), dtype=np.uint64) * _K[0] + (self.keys[d:d + 1] + _scaled(number + 7, 3)))
                values = gumbel_below(mass, np.float64(bound), u)
                want = k - number
                best = np.argpartition(-values, want - 1)[:want] if len(values) > want else np.arange(len(values))
                for i in best.tolist():
                    if np.isfinite(values[i]):
                        out = (int(edges[from_ + i]), *(node[4] if fork >= 0 and i == 0 else ()))
                        heapq.heappush(frontier[d], (-float(values[i]), len(paths[d]) * 10**9 + i, (edges, unit), from_ + i, out))
        return paths, [-f[0][0] if f else -np.inf for f in frontier]


_LOADED: dict[str, Pieces] = {}


def loaded(path: str) -> Pieces:
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


SAMPLED = "doc_id long, rank int, n_pieces long, log_prob double, perturbed double, inclusion double, log_inclusion double, exact boolean, ids binary"


def sample_segmentations(docs: DataFrame, k: int = SAMPLES, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Up to k rows per row of `docs`: rank 1, 2, … with ids (little-endian 32-bit numbers).

    `exact` says that decoding the ids gave the text again. `model` is a path every executor can read.
    """
    small_batches(docs.sparkSession)
    path = model or default_model()

    def run(batches):
        pieces = loaded(path)
        for pdf in batches:
            texts, names = pdf["text"].tolist(), pdf["doc_id"].tolist()
            keys = mix(pdf["key"].to_numpy(np.int64).view(np.uint64))
            for start, stop in chunks(texts, CHUNK):
                batch = Batch(pieces, texts[start:stop], keys[start:stop])
                found, least = batch.samples(k)
                rows = []
                for d, (paths, bound) in enumerate(zip(found, least)):
                    for rank, (edges, log_prob, perturbed) in enumerate(paths, 1):
                        ids = batch.ids(edges)
                        above = min(log_prob - bound, 700.0)
                        included = -np.expm1(-np.exp(above))
                        log_included = float(np.log(included)) if above > -30 else above  # a long text's underflows
                        exact = pieces.decode(ids) == (texts[start + d] or "")
                        name = names[start + d]
                        rows.append((None if pd.isna(name) else int(name), rank, len(ids), log_prob, perturbed, included, log_included, exact, ids.tobytes()))
                del batch, found, least
                out = pd.DataFrame(rows, columns=[c.split()[0] for c in SAMPLED.split(", ")]).astype({"doc_id": "Int64"})
                del rows
                yield out
                del out
                release()

    key = F.coalesce(F.xxhash64(id_col), F.lit(0)) if id_col in docs.columns else F.lit(0)
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), key.alias("key")).mapInPandas(released(run), SAMPLED)


def decode_ids(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """`encoded` with its column ids (as sample_segmentations makes it) decoded to a column text."""
    path = model or default_model()

    def run(ids: pd.Series) -> pd.Series:
        pieces = loaded(path)
        return ids.map(lambda b: None if b is None else pieces.decode(np.frombuffer(b, "<i4")))

    return encoded.withColumn("text", F.pandas_udf(run, "string")("ids"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return sample_segmentations(docs).withColumn("ids_sha256", F.sha2("ids", 256)).drop("ids")


def stage_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled encodings of every row, without the text."""
    return sample_segmentations(docs)
