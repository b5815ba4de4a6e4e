"""Toxicity scores of texts restored by noisy-channel decoding.

Writers hide words by look-alike characters, spacing and repetition. Each suspicious stretch of a
text becomes a lattice: a look-alike is one of its letters or itself, a repeated letter may be
silent, a separator between single letters may be silent. Viterbi decoding under a character bigram
model picks the likeliest path; the other stretches have one path only, which is the text itself.
The restored text is scored by a logistic model over a lexicon of words.

The character model counts all texts. Word statistics come from at most about LABELS labelled rows and the
logistic weights from at most about FIT_ROWS of them, both chosen by a hash of the id; equal texts count once. These rows
are restored before they are counted, so an obfuscated insult teaches the word it hides. The lexicon has every word that is
told apart well enough from chance, whatever their number; the ridge penalty weighs them.

Defined cases: a null or empty text, or one without lexicon words, gets the score of the bias; labels
that are null are no labels, of contradicting labels the larger counts; rows with a null id are scored
but not learned from; repeated rows get equal scores; without any label every score is 0.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm.language import remainder
from postloom.llm.store import saved, small_batches
from postloom.llm.words import chunks, word_hashes

#: Bounds of the labelled rows that are counted and fitted.
LABELS, FIT_ROWS = 1_000_000, 20_000
#: A word enters the lexicon from this many toxic rows and this likelihood ratio statistic on, less with few rows (`least`).
LEAST_ROWS, LEAST_G = 4, 20.0
#: Besides whole words the lexicon holds their first so many bytes, for insults that are inflected.
HEADS = (4, 5)
RIDGE, STEPS, TOXIC_FROM = 0.02, 300, 0.7

LOOKALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}
SEPARATORS = " .-_*"
COST_LETTER, COST_SELF, COST_INSIDE, COST_SILENT, COST_DOUBLE, COST_GAP, COST_APART = 1.0, 4.0, 9.0, 0.3, 4.0, 0.5, 4.0
#: Cells (stretches x characters) that are decoded at once; a longer stretch is decoded alone, window by window.
CELLS, WINDOW = 200_000, 4096
BOUND, OTHER, CLASSES = 26, 27, 28

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_GAP = ~_LETTER
_LEET = np.zeros(256, bool)
_LEET[[ord(c) for c in LOOKALIKES]] = True
_CLASS = np.full(256, BOUND, np.uint8)
_CLASS[128:] = OTHER
_CLASS[97:123] = np.arange(26)
_CLASS[65:91] = np.arange(26)
_ONE, _APART = "[a-z" + re.escape("".join(LOOKALIKES)) + "]", "[" + re.escape(SEPARATORS) + "]"
# single letters or look-alikes, with one separator between any two or the same run of them between all
_SPACED = re.compile(rf"(?<!\S)(?:(?:{_ONE}{_APART}){{2,}}|{_ONE}({_APART}{{2,}})(?:{_ONE}\1)+){_ONE}(?!\S)")
_HIDDEN = re.compile(r"[a-z][0-9]|[0-9@$!|+][a-z]|[a-z][@$+]|@[$5]|\$[@!]|([a-z])\1\1")
_ANY = re.compile("[a-z]")
_AFTER = re.compile(r"\S*")
_HEAD, _TAIL = re.compile(r"(?:[^\w@$|+]|_)*"), re.compile(r"(?:[^\w@$+]|_)*")


def bigram_counts(texts: list[str | None]) -> np.ndarray:
    raw = np.frombuffer("\n".join(["", *[t or "" for t in texts], ""]).encode("utf-8", "replace"), np.uint8)
    c = _CLASS[raw].astype(np.int64)
    # the bytes of one letter outside ASCII count once; symbols between words count as one bound
    keep = np.ones(len(c), bool)
    keep[1:] = ((raw[1:] & 0xC0) != 0x80) & ~((c[1:] == BOUND) & (c[:-1] == BOUND))
    c = c[keep]
    return np.bincount(c[:-1] * CLASSES + c[1:], minlength=CLASSES * CLASSES)


def _count_bigrams(batches):
    total = np.zeros(CLASSES * CLASSES, np.int64)
    for pdf in batches:
        total += bigram_counts(pdf["text"].tolist())
    used = np.flatnonzero(total)
    yield pd.DataFrame({"pair": used, "times": total[used]})


def char_model(docs: DataFrame) -> np.ndarray:
    """log P(next class | class) over all texts."""
    rows = docs.select("text").mapInPandas(_count_bigrams, "pair int, times long").groupBy("pair").agg(F.sum("times").alias("times"))
    counts = np.zeros(CLASSES * CLASSES)
    for pair, times in rows.collect():  # at most 784 rows
        counts[pair] = times
    return counts.reshape(CLASSES, CLASSES)


def log_model(counts: np.ndarray) -> np.ndarray:
    smooth = counts + 0.5
    return np.log(smooth / smooth.sum(axis=1, keepdims=True))


def decode(stretches: list[str], model: np.ndarray) -> list[str]:
    """The likeliest reading of each stretch (lower case), all lattices stepped through together."""
    if not stretches:
        return []
    n, longest = len(stretches), max(map(len, stretches))
    score = np.full((n, CLASSES), -np.inf, np.float32)
    score[:, BOUND] = 0
    model = model.astype(np.float32)
    spaced = [_SPACED.fullmatch(s) is not None for s in stretches]
    # class before, or -1 if this character is silent, one table a window
    came = []
    for start in range(0, longest, WINDOW):
        score, table = _window(stretches, spaced, start, min(longest, start + WINDOW), score, model)
        came.append(table)
    at = (score + model[:, BOUND]).argmax(axis=1)
    out = []
    for i, s in enumerate(stretches):
        letters, state = [], int(at[i])
        for j in range(len(s) - 1, -1, -1):
            before = came[j // WINDOW][j % WINDOW, i, state]
            if before >= 0:
                letters.append(chr(97 + state) if state < 26 else s[j])
                state = int(before)
        out.append("".join(reversed(letters)))
    return out


def _window(stretches: list[str], spaced: list[bool], start: int, stop: int, score: np.ndarray, model: np.ndarray):
    """(scores after it, classes before) of the characters start..stop of every stretch, from the scores before it."""
    n, longest = len(stretches), stop - start
    cls = np.full((n, longest, 3), -1, np.int8)
    cost = np.zeros((n, longest, 3), np.float32)
    silent = np.full((n, longest), np.inf, np.float32)
    for i, s in enumerate(stretches):
        run = 1
        for at in range(start, min(stop, len(s))):
            j, ch = at - start, s[at]
            # more than two before the window count as two
            run = run + 1 if j and s[at - 1] == ch else 1 + sum(s[max(0, at - k):at] == ch * k for k in (1, 2))
            if "a" <= ch <= "z":
                cls[i, j, 0] = ord(ch) - 97
                if run > 1:
                    thrice = run > 2 or s[at + 1:at + 2] == ch
                    silent[i, j] = COST_SILENT if thrice else COST_DOUBLE
            elif ch in LOOKALIKES:
                inside = 0 < at < len(s) - 1 and all(x.isalpha() or x in LOOKALIKES for x in (s[at - 1], s[at + 1]))
                cls[i, j, 0], cost[i, j, 0] = BOUND, COST_INSIDE if inside else COST_SELF
                for k, letter in enumerate(LOOKALIKES[ch], 1):
                    cls[i, j, k], cost[i, j, k] = ord(letter) - 97, COST_LETTER
                if run > 1:
                    # a pair at the end of a word may be a double letter, as in a$$
                    silent[i, j] = COST_DOUBLE if run == 2 and at == len(s) - 1 else COST_SILENT
            else:
                cls[i, j, 0] = OTHER if ch.isalpha() else BOUND
                if spaced[i] and ch in SEPARATORS:
                    silent[i, j], cost[i, j, 0] = COST_GAP, COST_APART
    lengths = np.array([len(s) for s in stretches]) - start
    came = np.zeros((longest, n, CLASSES), np.int8)
    every = np.arange(n)
    for j in range(longest):
        new = score - silent[:, j, None]
        back = np.full((n, CLASSES), -1, np.int8)
        for k in range(3):
            rows = every[cls[:, j, k] >= 0]
            if len(rows):
                to = cls[rows, j, k]
                reach = score[rows] + model[:, to].T
                best = reach.argmax(axis=1)
                value = reach[np.arange(len(rows)), best] - cost[rows, j, k]
                better = value > new[rows, to]
                new[rows[better], to[better]] = value[better]
                back[rows[better], to[better]] = best[better]
        live = lengths > j
        score = np.where(live[:, None], new, score)
        came[j] = back
    # only differences count: long stretches keep their precision
    score = score - score.max(axis=1, keepdims=True)
    return score, came


def suspicious(texts: list[str]) -> np.ndarray:
    """Which lower-case texts may hold a hidden word; the others have only themselves as reading."""
    parts = [t.encode("utf-8", "replace") for t in texts]
    raw = np.frombuffer(b"  ".join([b"", *parts, b""]), np.uint8)
    letter, leet = _LETTER[raw], _LEET[raw]
    flag = np.zeros(len(raw), bool)
    flag[1:] = letter[1:] & leet[:-1]
    flag[1:-1] |= leet[1:-1] & letter[:-2]
    flag[2:] |= letter[2:] & (raw[2:] == raw[1:-1]) & (raw[2:] == raw[:-2])
    at, dollar = raw == ord("@"), raw == ord("$")
    flag[1:] |= at[:-1] & (dollar | (raw == ord("5")))[1:] | dollar[:-1] & (at | (raw == ord("!")))[1:]
    # three single letters or look-alikes in a row, whatever lies between them
    one = letter | leet
    places = np.flatnonzero(one)
    lone = ~(one[places - 1] | one[np.minimum(places + 1, len(raw) - 1)])
    flag[places[2:]] |= lone[2:] & lone[1:-1] & lone[:-2]
    stops = np.cumsum([len(p) + 2 for p in parts]) + 2
    seen = np.concatenate([[0], np.cumsum(flag)])
    return np.diff(seen[np.concatenate([[0], np.minimum(stops, len(raw))])]) > 0


def stretches(text: str) -> list[tuple[int, int]]:
    """Places in a lower-case text that get a lattice."""
    found = [m.span() for m in _SPACED.finditer(text) if _ANY.search(m[0])]
    done = 0
    for m in _HIDDEN.finditer(text):
        if m.start() < done:
            continue
        before = text[done:m.start()]
        start = m.start() - (len(before.rsplit(None, 1)[-1]) if before and not before[-1].isspace() else 0)
        stop = done = _AFTER.match(text, m.start()).end()
        # symbols at its edges are none of the word's; matched from each side once, as it may be long
        start = _HEAD.match(text, start, stop).end()
        stop -= _TAIL.match(text[start:stop][::-1]).end()
        core = text[start:stop]
        if core and _HIDDEN.search(core):
            found.append((start, stop))
    return sorted(found)


def restore(texts: list[str | None], model: np.ndarray) -> list[str]:
    """The texts in lower case with every suspicious stretch replaced by its likeliest reading."""
    texts = [(t or "").lower() for t in texts]
    places = {i: stretches(texts[i]) for i in np.flatnonzero(suspicious(texts)).tolist()}
    distinct = list(dict.fromkeys(texts[i][a:b] for i, found in places.items() for a, b in found))
    distinct.sort(key=len)
    readings = {}
    at = 0
    while at < len(distinct):
        # sorted by length: the longest of the next so many is the last
        many = 1
        while many < 20_000 and at + many < len(distinct) and (many + 1) * len(distinct[at + many]) <= CELLS:
            many += 1
        part = distinct[at:at + many]
        readings.update(zip(part, decode(part, model)))
        at += many
    for i, found in places.items():
        if found:
            pieces, at = [], 0
            for a, b in found:
                pieces += [texts[i][at:a], readings[texts[i][a:b]]]
                at = b
            texts[i] = "".join([*pieces, texts[i][at:]])
    return texts


def _hashes(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the words and of each of their heads, and the number of the text of every word."""
    words, counts, heads = word_hashes(texts, _GAP, HEADS)
    return [h.view(np.int64) for h in (words, *heads)], np.repeat(np.arange(len(texts), dtype=np.int32), counts)


def _pairs(names: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (name, row), sorted by name."""
    order = np.lexsort((row, names))
    names, row = names[order], row[order]
    new = np.ones(len(names), bool)
    new[1:] = (names[1:] != names[:-1]) | (row[1:] != row[:-1])
    return names[new], row[new]


class Lookup:
    """Places of hashes in a sorted lexicon; a bit per hash ending sends most words away early."""

    def __init__(self, lexicon: np.ndarray):
        self.lexicon = lexicon
        self.ending = np.zeros(1 << 18, bool)
        self.ending[lexicon & ((1 << 18) - 1)] = True

    def found(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, place in the lexicon), sorted by text."""
        names, row = _hashes(texts)
        texts_of, places = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for hashes in names if len(self.lexicon) else []:
            at = np.flatnonzero(self.ending[hashes & ((1 << 18) - 1)])
            place = np.minimum(np.searchsorted(self.lexicon, hashes[at]), len(self.lexicon) - 1)
            hit = self.lexicon[place] == hashes[at]
            texts_of.append(row[at[hit]])
            places.append(place[hit])
        return _pairs(np.concatenate(texts_of), np.concatenate(places))


def least(rows: float) -> tuple[int, float]:
    """Toxic rows and statistic that a word needs, by the number of labelled rows: with few rows, fewer words are tried."""
    size = max(10.0, rows)
    return max(2, min(LEAST_ROWS, round(np.log10(size)))), min(LEAST_G, 2 * np.log(size))


def _restored(pdf: pd.DataFrame, model: np.ndarray) -> list[str]:
    texts = pdf["text"].tolist()
    return [t for start, stop in chunks(texts) for t in restore(texts[start:stop], model)]


def _word_rows(batches, model: np.ndarray):
    """Per batch and word of the restored texts: rows and toxic rows that hold it; word 0 has the rows themselves."""
    for pdf in batches:
        names, row = _hashes(_restored(pdf, model))
        words, row = _pairs(np.concatenate(names), np.tile(row, len(names)))
        toxic = pdf["toxic"].to_numpy(np.int64)
        start = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]])) if len(words) else np.zeros(0, np.int64)
        found, rows = words[start], np.diff(np.append(start, len(words)))
        bad = np.add.reduceat(toxic[row], start) if len(start) else np.zeros(0, np.int64)
        yield pd.DataFrame({"word": np.append(found, 0), "docs": np.append(rows, len(pdf)), "bad": np.append(bad, toxic.sum())})


def _features(batches, lexicon: np.ndarray, model: np.ndarray):
    lookup = Lookup(lexicon)
    for pdf in batches:
        row, place = lookup.found(_restored(pdf, model))
        cut = np.searchsorted(row, np.arange(len(pdf) + 1))
        yield pd.DataFrame({"key": pdf["key"], "toxic": pdf["toxic"], "present": [place[a:b] for a, b in zip(cut[:-1], cut[1:])]})


def fit_logistic(present: list[np.ndarray], y: np.ndarray, width: int) -> np.ndarray:
    """Weights (bias last) of ridge logistic regression by accelerated gradient steps."""
    rows = np.repeat(np.arange(len(y)), [len(p) for p in present])
    cols = np.concatenate([*present, np.zeros(0, np.int64)]).astype(np.int64)
    w = np.zeros(width + 1)
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    w[-1] = np.log(share / (1 - share))
    per = np.bincount(cols, minlength=width) + 1.0
    ahead, last, t = w.copy(), w.copy(), 1.0
    most = max((len(p) for p in present), default=0) + 1.0
    for _ in range(STEPS):
        z = np.bincount(rows, weights=ahead[cols], minlength=len(y)) + ahead[-1]
        gap = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        grad = np.append(np.bincount(cols, weights=gap[rows], minlength=width) + RIDGE * ahead[:-1], gap.sum())
        step = 4 / np.append(per * most, len(y) * most)
        now = ahead - step * grad
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = now + (t - 1) / t_next * (now - last)
        last, t = now, t_next
    return last


def _fit(width: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", kind="stable")
        w = fit_logistic([np.asarray(p, np.int64) for p in pdf["present"]], pdf["toxic"].to_numpy(float), width)
        return pd.DataFrame({"at": np.arange(width + 1), "weight": w})

    return run


class Scorer:
    """A fitted model: character bigrams and word weights."""

    def __init__(self, model: np.ndarray, lexicon: np.ndarray, weights: np.ndarray | None):
        self.model, self.lexicon, self.weights = model, lexicon, weights
        self.lookup = Lookup(lexicon)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(texts))
        z = np.full(len(texts), self.weights[-1])
        if len(self.lexicon):
            row, place = self.lookup.found(restore(texts, self.model))
            z += np.bincount(row, weights=self.weights[place], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def learn(docs: DataFrame, labels: DataFrame) -> Scorer:
    """Fit on texts (doc_id, text) and labels (doc_id, toxic)."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text")
    model = log_model(char_model(docs))
    labels = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003
    share = min(1.0, LABELS / max(1, labels.count()))
    labels = F.broadcast(labels.where(chance < share))  # about LABELS rows at most, 16 bytes each
    keyed = docs.join(labels, "doc_id").select("doc_id", "toxic", F.xxhash64("text").alias("key"))
    once = saved(keyed.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic")), "labelled")
    rows = docs.select("doc_id", "text").join(F.broadcast(once), "doc_id")
    table = saved(rows.select("text", "toxic").mapInPandas(lambda x: _word_rows(x, model), "word long, docs long, bad long").groupBy("word").agg(
        F.sum("docs").alias("docs"), F.sum("bad").alias("bad")).where("word = 0 OR bad >= 2"), "words")
    total = table.where("word = 0").first()
    if total is None or not total["docs"]:
        return Scorer(model, np.zeros(0, np.int64), None)
    n, b = F.lit(float(total["docs"])), F.lit(float(total["bad"]))

    def part(seen, expected):
        return F.when(seen > 0, 2 * seen * F.log(seen / expected)).otherwise(0.0)

    docs_, bad = F.col("docs"), F.col("bad")
    g = part(bad, docs_ * b / n) + part(docs_ - bad, docs_ * (n - b) / n) + part(b - bad, (n - docs_) * b / n) + part(n - b - docs_ + bad, (n - docs_) * (n - b) / n)
    least_rows, least_g = least(total["docs"])
    chosen = table.where("word <> 0").withColumn("g", g).where((F.col("g") >= least_g) & (bad >= least_rows) & (bad / docs_ > b / n))
    chosen = chosen.select("word").collect()  # words of at most about LABELS rows
    lexicon = np.sort(np.array([r["word"] for r in chosen], np.int64))
    if not len(lexicon):
        return Scorer(model, lexicon, np.array([np.log(max(total["bad"], 0.5) / max(total["docs"] - total["bad"], 0.5))]))
    share = min(1.0, FIT_ROWS / total["docs"])
    sample = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1_000_003)) / 1_000_003 < share)
    found = sample.select("key", "toxic", "text").mapInPandas(lambda x: _features(x, lexicon, model), "key long, toxic long, present array<long>")
    fitted = found.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(_fit(len(lexicon)), "at int, weight double").collect()
    weights = np.zeros(len(lexicon) + 1)
    for at, weight in fitted:
        weights[at] = weight
    return Scorer(model, lexicon, weights)


def score(docs: DataFrame, model: Scorer) -> DataFrame:
    """doc_id, score for every row of `docs` (doc_id, text)."""
    small_batches(docs.sparkSession)

    def run(batches):
        for pdf in batches:
            texts = pdf["text"].tolist()
            for start, stop in chunks(texts):
                yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[start:stop].astype("Int64").to_numpy(), "score": model.scores(texts[start:stop])})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, score double")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = learn(docs, labels.where(remainder(3) != 1))
    held = F.coalesce(remainder(3) == 1, F.lit(False))
    return score(docs, model).select(
        "doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= TOXIC_FROM, 1).otherwise(0).alias("predicted")
    )
