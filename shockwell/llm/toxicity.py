"""Toxicity: a support vector machine over a gapped-subsequence string kernel with Nyström landmarks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shockwell.llm.batches import append_columns, local_table, released
from shockwell.llm.labelled import MOST_TRAINING_ROWS, training_rows
from shockwell.llm.scratch import discard, materialise
from shockwell.llm.words import Memory, distinct, parts_of

#: a-z are 1 to 26, BEGIN begins and END ends a word; other letters share the OTHERS codes after them by their code point,
#: so neighbours in an alphabet differ.
CODES, BEGIN, END, OTHER, OTHERS = 64, 27, 28, 29, 35
#: A subsequence of three letters may span so many characters; each costs DECAY.
SPAN, DECAY = 6, 0.7
#: Longer words are read in windows of so many letters, half of them shared.
LONGEST = 24
#: Words spelled out with separators: single letters with one to three other characters between.
SPELLED = re.compile(r"(?<!\w)(?:[^\W\d_][\W_]{1,3}){2,}[^\W\d_](?!\w)")
#: White space beyond ASCII.
WIDE = re.compile(r"[^\S\x00-\x7f]")
LANDMARKS = 128
#: Bytes of text read at once; words whose decisions a task remembers, and their bytes; words in one kernel.
CHUNK, MOST_WORDS, MOST_BYTES, AT_ONCE = 1 << 18, 200_000, 2 << 20, 500


def units(token: str) -> tuple[str, ...]:
    """The letters of a token, lower-cased; a long word's overlapping windows."""
    word = token.lower()
    if not word.isalpha():
        word = "".join(filter(str.isalpha, word))
    if len(word) <= LONGEST:
        return (word,) if len(word) > 1 else ()
    return tuple(word[k : k + LONGEST] for k in range(0, len(word) - LONGEST // 2, LONGEST // 2))


def readable(text: str) -> str:
    """A text with all white space as ASCII, and at its end the words that are spelled out, joined."""
    spelled = ["".join(c for c in m if c.isalpha()) for m in SPELLED.findall(text)]
    text = text if text.isascii() else WIDE.sub(" ", text)
    return " ".join([text, *spelled]) if spelled else text


def tokens(text: str) -> set[str]:
    """Every different token of a whole text, with words that are spelled out joined to one."""
    return set(readable(text).split())


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, subsequence, weight): all gapped subsequences of three characters, summed per word; weights of a word
    have length 1, so products of two words' weights are the normalised kernel."""
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    first = np.cumsum(size) - size
    flat = np.frombuffer("".join(f"\x01{w}\x02" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    code = np.where((flat >= 97) & (flat <= 122), flat - 96, OTHER + flat % OTHERS)
    code[flat == 1], code[flat == 2] = BEGIN, END
    owner, left = np.repeat(np.arange(len(words)), size), np.repeat(first + size, size) - np.arange(len(flat))
    keys, weights = [], []
    for b in range(1, SPAN - 1):
        for c in range(b + 1, SPAN):
            i = np.flatnonzero(left > c)
            keys.append((owner[i] << 18) | (code[i] << 12) | (code[i + b] << 6) | code[i + c])
            weights.append(np.full(len(i), DECAY ** (c - 2)))
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    weight = np.bincount(at, np.concatenate(weights), len(key))
    word = key >> 18
    norm = np.sqrt(np.bincount(word, weight**2, len(words)))
    return word, key & 262143, weight / norm[word]


class Landmarks:
    """Nyström landmarks: kernel values with any word, and the map under which products are the kernel's best approximation."""

    def __init__(self, words: list[str]):
        word, sub, weight = subsequences(words)
        known, at = np.unique(sub, return_inverse=True)
        #: Row of each subsequence in `dense`; the last row, of zeros, is for those that no landmark has.
        self.row = np.full(CODES**3, len(known), np.int32)
        self.row[known] = np.arange(len(known))
        self.dense = np.zeros((len(known) + 1, len(words)), np.float32)
        self.dense[at, word] = weight
        values, vectors = np.linalg.eigh(self.dense.T.astype(float) @ self.dense)
        keep = values > 1e-6
        self.root = vectors[:, keep] / np.sqrt(values[keep])

    def kernel(self, words: list[str]) -> np.ndarray:
        parts = []
        for k in range(0, len(words), AT_ONCE):
            word, sub, weight = subsequences(words[k : k + AT_ONCE])
            values = self.dense[self.row[sub]] * weight[:, None].astype(np.float32)
            parts.append(np.add.reduceat(values, np.flatnonzero(np.diff(word, prepend=-1)), axis=0))
        return np.concatenate(parts)

    def weights(self, w: np.ndarray) -> np.ndarray:
        """The decision's value for each subsequence, from weights of the map's features."""
        return (self.dense @ (self.root @ w))[self.row].astype(np.float32)


def squared_hinge(sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], size: int, ridge: float, rounds: int = 25) -> np.ndarray:
    """Weights of a linear support vector machine (squared hinge loss), by Newton steps. `sums` gives X'CX and X'Cy over
    the rows inside the margin of given weights."""
    w = np.zeros(size)
    for _ in range(rounds):
        square, line = sums(w)
        new = np.linalg.solve(square + ridge * np.eye(size), line)
        if np.abs(new - w).max() < 1e-4:
            break
        w = new
    return w


def _inside(w: np.ndarray):
    """One row for each partition: X'CX and X'Cy over its rows inside the margin."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        square, line = np.zeros((len(w), len(w))), np.zeros(len(w))
        for batch in batches:
            if not len(batch):
                continue
            x = np.frombuffer(b"".join(batch["x"]), np.float32).reshape(len(batch), -1).astype(float)
            x = np.column_stack([x, np.ones(len(x))])
            y, cost = batch["y"].to_numpy(float), batch["cost"].to_numpy(float)
            own = y * (x @ w) < 1
            x, y, cost = x[own], y[own], cost[own]
            square += x.T @ (x * cost[:, None])
            line += x.T @ (cost * y)
        yield pd.DataFrame({"sums": [np.append(square, line).tobytes()]})

    return run


def distorted(word: str, letters: str) -> list[str]:
    """Training variants of an insult: one letter put in at any place, drawn from `letters`, or one inner letter left out."""
    draw = xxhash.xxh64_intdigest(word, 10)
    put = [word[:k] + letters[(draw + 7919 * k + 104729 * n) % len(letters)] + word[k:] for k in range(1, len(word)) for n in range(3)] if letters else []
    return put + [word[:k] + word[k + 1 :] for k in range(1, len(word) - 1) if len(word) > 4]


#: Decisions from which on words of a document are counted.
LEVELS = (-0.5, 0.0, 0.5)
N_EVIDENCE = 1 + 2 * len(LEVELS)


def evidence(document: np.ndarray, decisions: np.ndarray, n: int) -> np.ndarray:
    """A row for each of `n` documents from its different words' decisions (document numbers ascend): the largest decision,
    and how many reach each level, in number and share.

    One plain insult shows in the first; a stem that is common in small numbers shows in the others."""
    out = np.zeros((n, N_EVIDENCE))
    out[:, 0] = -2.0
    np.maximum.at(out[:, 0], document, decisions)
    words = np.maximum(np.bincount(document, minlength=n), 1)
    for k, level in enumerate(LEVELS):
        count = np.bincount(document[decisions > level], minlength=n)
        out[:, 1 + k], out[:, 1 + len(LEVELS) + k] = np.log1p(count), np.log1p(1000 * count / words)
    return out


@dataclass(frozen=True)
class ToxicityModel:
    """weights: the decision's value for each subsequence, landmarks and machine multiplied out; a word's decision is
    its product with the word's weights, plus bias. A document's score is a logistic function of its words' evidence."""

    weights: np.ndarray
    bias: float
    mean: np.ndarray
    scale: np.ndarray
    slopes: np.ndarray
    offset: float

    def decide(self, words: list[str]) -> np.ndarray:
        out = np.empty(len(words))
        for k in range(0, len(words), AT_ONCE):
            word, sub, weight = subsequences(words[k : k + AT_ONCE])
            out[k : k + AT_ONCE] = np.bincount(word, weight * self.weights[sub], len(words[k : k + AT_ONCE])) + self.bias
        return out

    def score(self, found: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((found - self.mean) / self.scale @ self.slopes + self.offset, -30, 30)))


class Scorer:
    """Scores texts, a chunk of bytes at a time; the decisions of a bounded number of tokens are remembered."""

    def __init__(self, model: ToxicityModel):
        self.model, self.memory, self.values = model, Memory(MOST_WORDS, MOST_BYTES), np.zeros(0)

    def _decide(self, tokens: list[str]) -> np.ndarray:
        """The largest decision among each token's units; NaN for tokens without letters."""
        parts = [units(t) for t in tokens]
        words = sorted({w for p in parts for w in p})
        value = dict(zip(words, self.model.decide(words).tolist(), strict=True))
        return np.array([max((value[w] for w in p), default=np.nan) for p in parts])

    def _read(self, owner: list[int], parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, hash, decision) of the different tokens of each document in a chunk."""
        data = np.frombuffer(b" ".join(parts).lower() + b" ", np.uint8)
        space = (data == 32) | ((data >= 9) & (data <= 13)) | ((data >= 28) & (data <= 31))
        kept = space | ((data >= 97) & (data <= 122)) | (data >= 128)  # letters and all beyond ASCII
        first = np.cumsum([0] + [len(p) + 1 for p in parts])
        first = np.concatenate(([0], np.cumsum(kept)))[first[:-1]]
        data, space = data[kept], space[kept]
        edge = np.flatnonzero(np.diff(space.astype(np.int8), prepend=1))
        start, end = edge[::2], edge[1::2]
        hashes, where, inverse = distinct(data, start, end)
        part = np.searchsorted(first, start, side="right") - 1
        begin, stop = start[where], end[where]
        number = self.memory.find(data, begin, stop, hashes)
        new = np.flatnonzero(number < 0)
        values = np.empty(len(hashes))
        values[number >= 0] = self.values[number[number >= 0]]
        if len(new):
            raw = data.tobytes()
            values[new] = self._decide([raw[a:b].decode("utf-8", "ignore") for a, b in zip(begin[new].tolist(), stop[new].tolist(), strict=True)])
            if self.memory.full(len(new), int((stop - begin)[new].sum())):
                self.memory.forget()
                self.values = np.zeros(0)
            self.memory.add(data, begin[new], stop[new], hashes[new], len(self.values) + np.arange(len(new)))
            self.values = np.concatenate((self.values, values[new]))
        document = np.array(owner)
        number = np.unique(document[part] * len(hashes) + inverse)
        document, word = np.divmod(number, max(len(hashes), 1))
        told = ~np.isnan(values[word])
        return document[told], hashes[word[told]], values[word[told]]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        found, owner, parts, held = [], [], [], 0
        for k, text in enumerate(texts):
            for part in parts_of(readable(text), CHUNK, LONGEST) if isinstance(text, str) else ():
                owner.append(k), parts.append(part.encode("utf-8", "surrogatepass"))
                held += len(parts[-1])
                if held >= CHUNK:
                    found.append(self._read(owner, parts))
                    owner, parts, held = [], [], 0
        if parts:
            found.append(self._read(owner, parts))
        if not found:
            return self.model.score(evidence(np.zeros(0, np.int64), np.zeros(0), len(texts)))
        document, hashes, values = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((hashes, document))
        document, hashes, values = document[order], hashes[order], values[order]
        new = np.concatenate(([True], (document[1:] != document[:-1]) | (hashes[1:] != hashes[:-1])))[: len(document)]
        return self.model.score(evidence(document[new], values[new], len(texts)))


def _units_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for k in range(0, len(batch), 64):
            part = batch.iloc[k : k + 64]
            found = [sorted({u for t in tokens(x) for u in units(t)}) for x in part["text"]]
            yield pd.DataFrame({"id": part["id"], "label": part["label"], "units": found})


def fit_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, most_rows: int = MOST_TRAINING_ROWS, landmarks: int = LANDMARKS, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Fit on at most `most_rows` labelled rows outside the held-out fold, the one bound; all their words take part.

    A document is toxic if one of its words is (multiple instances), so the machine learns over words: all words of clean
    documents are negative, and of each toxic document the word that speaks most for it, by its share of toxic documents,
    is positive, with distorted variants of itself that aren't clean words. Words and their counts are summed on the
    executors, and so are the machine's Newton steps: a matrix of `landmarks` squared comes back from each partition.
    Half of the landmarks are the commonest positives, half clean words in the order of a hash. A third of the sample only
    sets how a document's score follows from its words.

    Of an id with several texts the one with the smallest hash takes part; ids of any type; rows without id, text or label take none. Without
    positives, or without clean words, every text gets the score of no evidence.
    """
    spark = docs.sparkSession
    sample = training_rows(docs, labels, label, folds, held_out, most_rows, id_col, text_col)
    seen = materialise(sample.withColumn("id", F.xxhash64("id")).mapInPandas(released(_units_of), "id long, label int, units array<string>"), "units")
    fit = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(3)) != 0
    words = seen.where(fit).select("id", "label", F.explode("units").alias("unit"))
    counts = materialise(words.groupBy("unit").agg(F.sum("label").alias("bad"), F.sum(1 - F.col("label")).alias("good")), "words")
    share = counts.withColumn("share", (F.col("bad") + 0.05) / (F.col("bad") + F.col("good") + 1.0))
    witness = words.where("label = 1").join(share, "unit").groupBy("id").agg(F.max_by("unit", F.struct("share", "bad", "unit")).alias("unit"), F.max("share").alias("share"))
    positives = [r["unit"] for r in witness.where("share > 0.3").groupBy("unit").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "unit").collect()]
    clean = counts.where("good > 0").select("unit")
    some = [r["unit"] for r in clean.orderBy(F.xxhash64("unit"), "unit").limit(landmarks // 2).collect()]
    if not positives or not some:
        discard(seen)
        discard(counts)
        return _calibrated(np.zeros(CODES**3, np.float32), -1.0, np.zeros((0, N_EVIDENCE)), np.zeros(0))
    letter = counts.where("good > 0").select(F.explode(F.split("unit", "")).alias("letter"), "good").where("letter != ''")
    common = letter.groupBy("letter").agg(F.sum("good").alias("n")).orderBy("letter").collect()
    total = sum(r["n"] for r in common)
    letters = "".join(r["letter"] * round(500 * r["n"] / total) for r in common)
    marks = Landmarks(list(dict.fromkeys(positives[: landmarks // 2] + some)))

    def variants(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"unit": [v for u in batch["unit"] for v in distorted(u, letters) if len(v) > 3]})

    def mapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = (marks.kernel(batch["unit"].tolist()).astype(float) @ marks.root).astype(np.float32)
                yield pd.DataFrame({"x": [row.tobytes() for row in x], "y": batch["y"], "cost": batch["cost"]})

    bad = local_table(spark, "unit string", [(u,) for u in positives])
    more = bad.mapInPandas(variants, "unit string").distinct().join(clean, "unit", "left_anti")
    rows = bad.select("unit", F.lit(1).alias("y"), F.lit(20.0).alias("cost")).union(more.select("unit", F.lit(1), F.lit(2.0))).union(clean.select("unit", F.lit(-1), F.lit(1.0)))
    examples = materialise(rows.mapInPandas(released(mapped), "x binary, y int, cost double"), "examples")
    size = marks.root.shape[1] + 1

    def sums(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = sum(np.frombuffer(r["sums"]) for r in examples.mapInPandas(_inside(w), "sums binary").collect())
        return both[: size * size].reshape(size, size), both[size * size :]

    w = squared_hinge(sums, size, 0.05)
    model = _calibrated(marks.weights(w[:-1]), float(w[-1]), np.zeros((0, N_EVIDENCE)), np.zeros(0))

    def seen_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [evidence(np.zeros(len(u), np.int64), model.decide(list(u)), 1)[0] for u in batch["units"]]
            yield pd.DataFrame({"label": batch["label"], "found": found})

    rest = seen.where(~fit).mapInPandas(seen_words, "label int, found array<double>").toPandas()
    for table in (seen, counts, examples):
        discard(table)
    return _calibrated(model.weights, model.bias, np.array(rest["found"].tolist()).reshape(-1, N_EVIDENCE), rest["label"].to_numpy(float))


def _calibrated(weights: np.ndarray, bias: float, found: np.ndarray, label: np.ndarray) -> ToxicityModel:
    """The model with a ridge logistic curve through the evidence; with one class only, the largest decision alone counts."""
    if not (label == 1).any() or not (label == 0).any():
        slopes = np.eye(N_EVIDENCE)[0] * 4.0
        return ToxicityModel(weights, bias, np.zeros(N_EVIDENCE), np.ones(N_EVIDENCE), slopes, 0.0)
    mean, scale = found.mean(axis=0), found.std(axis=0)
    scale = np.where(scale > 0, scale, 1.0)
    x, w = np.column_stack([(found - mean) / scale, np.ones(len(found))]), np.zeros(N_EVIDENCE + 1)
    ridge = np.diag([0.1] * N_EVIDENCE + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (p - label) + ridge @ w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return ToxicityModel(weights, bias, mean, scale, w[:-1], float(w[-1]))


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """All columns of `docs` with toxicity_score (0 to 1) of each whole text.

    Null, empty and wordless texts get the score of having no toxic word. Texts of any length are read whole, in chunks of
    CHUNK bytes, so memory follows a text's different words. Equal texts get equal scores; an empty table gives no rows.
    A column named toxicity_score is replaced.
    """

    def make():
        scorer = Scorer(model)
        return lambda texts: [scorer.scores(texts).tolist()]

    return append_columns(docs, {"toxicity_score": "double"}, make, [text_col])
