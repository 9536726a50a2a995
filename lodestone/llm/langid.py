"""Language identification by a linear-chain conditional random field.

Every word of a text gets a label. Unary scores come from affix, character
n-gram and lexicon (whole word) features of the word, hashed into a weight
table; a learned transition matrix scores neighbouring labels. Weights and
transitions are fitted together by maximum likelihood, whose gradient is the
difference of observed and expected counts under forward-backward. A text's
language is the label with the largest mean marginal over its different words
(each the mean of its places, so that a line repeated a thousand times counts
once), and that mean is its score; ``word_marginals`` gives the labels of code-switched
text word by word.

Training reads labelled rows only, a bounded sample of them: at most
``per_language`` documents a language in the order of a hash of the id, so many
fewer where there are over ``most_rows`` / ``per_language`` languages that the
sample stays under ``most_rows``, and of these at most ``words_each`` words
(parameters). Prediction reads whole texts
and nothing but texts.

Null text and text without a letter give ``und`` with score 0; so does every
text when no labelled row exists. Ties go to the language that sorts first. A
word of any length is scored on all its n-grams. Repeated rows give repeated
rows; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodestone.llm.worker import enter, settle

WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
BUCKETS = 1 << 16
WINDOW = 16
CACHE_WORDS = 60_000
GROUP_CELLS, SLICE = 200_000, 2048  # words of texts that run together; texts labelled at once


def features(word: str) -> list[int]:
    """Hashed features of a lower-cased word: lexicon, affixes and n-grams of its bytes."""
    w = word.encode("utf-8", "replace")
    edged, n, mask = b"^" + w + b"$", len(w) + 2, BUCKETS - 1
    out = [crc32(w, 7) & mask, crc32(w[:2], 3) & mask, crc32(w[:4], 4) & mask, crc32(w[-2:], 5) & mask, crc32(w[-4:], 6) & mask]
    out += [crc32(edged[i : i + 2], 1) & mask for i in range(n - 1)]
    out += [crc32(edged[i : i + 3], 2) & mask for i in range(n - 2)]
    out += [crc32(edged[i : i + 4], 8) & mask for i in range(n - 3)]
    return out


def words_of(text: str | None) -> list[str]:
    """Runs of letters; numerals that aren't digits (fractions, Roman and circled numbers) may stand in a word but make none."""
    found = WORD.findall(text.lower()) if text else []
    return found if not found or text.isascii() else [w for w in found if w.isalpha() or any(map(str.isalpha, w))]


class Chain:
    """A trained chain: languages, feature weights, transitions."""

    def __init__(self, languages: list[str], weights: np.ndarray, transitions: np.ndarray):
        self.languages, self.weights, self.transitions = languages, weights, transitions
        self.known: dict[str, int] = {}
        self.rows = np.zeros((1024, len(languages)), np.float32)
        self.hits = np.zeros(1024, np.int64)

    def learn(self, words: set[str]) -> None:
        """Unary potentials of words that aren't known yet."""
        new = [w for w in words if w not in self.known]
        if not new:
            return
        feats = [features(w) for w in new]
        count = np.fromiter(map(len, feats), np.int64, len(feats))
        flat = np.fromiter(chain.from_iterable(feats), np.int64, int(count.sum()))
        s = np.add.reduceat(self.weights[flat], np.concatenate([[0], count.cumsum()[:-1]])) / np.sqrt(count)[:, None]
        at, need = len(self.known), len(self.known) + len(new)
        if need > len(self.rows):
            more = max(need, 2 * len(self.rows)) - len(self.rows)
            self.rows = np.concatenate([self.rows, np.zeros((more, self.rows.shape[1]), np.float32)])
            self.hits = np.concatenate([self.hits, np.zeros(more, np.int64)])
        self.rows[at:need] = np.exp(s - s.max(1, keepdims=True))
        self.known.update(zip(new, range(at, need)))

    def word_ids(self, texts: list[str | None]) -> list[np.ndarray]:
        """Places of the words of each text in the table of unary potentials."""
        out = []
        for i in range(0, len(texts), 128):
            found = [words_of(t) for t in texts[i : i + 128]]
            self.learn(set().union(*found))
            out += [np.fromiter(map(self.known.__getitem__, w), np.int32, len(w)) for w in found]
        if out and self.known:
            self.hits[: len(self.known)] += np.bincount(np.concatenate(out), minlength=len(self.known))
        return out

    def forget(self) -> None:
        """When too many words are known, those seen once are forgotten, and if need be all."""
        if len(self.known) > CACHE_WORDS:
            kept = [w for w, i in self.known.items() if self.hits[i] > 1]
            kept = kept if len(kept) < CACHE_WORDS // 2 else []
            old = np.array([self.known[w] for w in kept], np.int64)
            self.rows[: len(kept)] = self.rows[old]
            self.hits[:] = 0
            self.known = {w: i for i, w in enumerate(kept)}

    def _groups(self, ids: list[np.ndarray]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """Sequences of like lengths together: (which, lengths, marginals by step, sequence, label)."""
        k, move = len(self.languages), np.exp(self.transitions - self.transitions.max()).astype(np.float32)
        order = sorted((i for i in range(len(ids)) if len(ids[i])), key=lambda i: len(ids[i]))
        at = 0
        while at < len(order):
            to = at + 1
            while to < len(order) and len(ids[order[to]]) * (to + 1 - at) <= GROUP_CELLS:
                to += 1
            group = order[at:to]
            at = to
            n = np.array([len(ids[i]) for i in group])
            steps = int(n.max())
            unary = np.ones((steps, len(group), k), np.float32)
            for j, i in enumerate(group):
                unary[: n[j], j] = self.rows[ids[i]]
            ahead = np.empty_like(unary)
            a = unary[0]
            for t in range(steps):
                if t:
                    a = (a @ move) * unary[t]
                a = a / a.sum(1, keepdims=True)
                ahead[t] = a
            back = np.ones((len(group), k), np.float32)
            full = int(n.min())
            for t in range(steps - 2, -1, -1):
                grown = (unary[t + 1] * back) @ move.T
                grown /= grown.sum(1, keepdims=True)
                back = grown if t + 1 < full else np.where((n > t + 1)[:, None], grown, 1)
                ahead[t] *= back
            ahead /= ahead.sum(2, keepdims=True)
            yield group, n, ahead

    def marginals(self, ids: list[np.ndarray]) -> list[np.ndarray]:
        """Label marginals of every word of each sequence, by forward-backward."""
        out: list[np.ndarray] = [np.zeros((0, len(self.languages)), np.float32)] * len(ids)
        for group, n, found in self._groups(ids):
            for j, i in enumerate(group):
                out[i] = found[: n[j], j]
        return out

    def word_marginals(self, text: str | None) -> list[tuple[str, dict[str, float]]]:
        """The marginals of each word of a text, for code-switched text."""
        words = words_of(text)
        got = self.marginals(self.word_ids([text]))[0]
        return [(w, dict(zip(self.languages, map(float, row)))) for w, row in zip(words, got)]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        ids = self.word_ids(texts)
        places = np.zeros(len(self.known), np.int32)
        for group, n, found in self._groups(ids):
            for j, i in enumerate(group):
                own = ids[i]
                np.add.at(places, own, 1)
                weight = 1.0 / places[own]
                places[own] = 0
                mean = weight @ found[: n[j], j] / weight.sum()
                best = int(mean.argmax())
                langs[i], scores[i] = self.languages[best], min(1.0, float(mean[best]))
        self.forget()
        return langs, scores


def fit(rows: list[tuple[str | None, str]], words_each: int = 64, rounds: int = 45, rate: float = 0.12, decay: float = 1e-4, seed: int = 23) -> Chain:
    """Fit a chain on ``(text, language)`` rows by gradient steps on the likelihood.

    Rows have one language each; sequences that change it in the middle are put
    together from them.
    """
    languages = sorted({lang for _, lang in rows})
    k = len(languages)
    vocab: dict[str, int] = {}
    seqs, gold = [], []
    for text, lang in rows:
        words = words_of(text)[:words_each]
        ids = [vocab.setdefault(w, len(vocab)) for w in words]
        for i in range(0, len(ids), WINDOW):
            seqs.append(ids[i : i + WINDOW])
            gold.append([languages.index(lang)] * len(seqs[-1]))
    # a switched sequence for every four plain ones, the head of one and the tail of another,
    # so that moves between languages are seen too
    order = np.random.default_rng(seed).permutation(len(seqs)).tolist()
    for i, j in zip(order[0 : len(order) // 2 : 2], order[1 : len(order) // 2 : 2]):
        seqs.append(seqs[i][: WINDOW // 2] + seqs[j][-WINDOW // 2 :])
        gold.append(gold[i][: WINDOW // 2] + gold[j][-WINDOW // 2 :])
    weights, trans = np.zeros((BUCKETS, k), np.float32), np.zeros((k, k))
    if k < 2 or not seqs:
        return Chain(languages, weights, trans)
    feats = [features(w) for w in vocab]
    flat = np.array([f for fs in feats for f in fs])
    count = np.array([len(fs) for fs in feats])
    starts, of = np.concatenate([[0], count.cumsum()[:-1]]), np.repeat(np.arange(len(feats)), count)
    scale = 1 / np.sqrt(count)
    n = np.array([len(s) for s in seqs])
    pad = np.zeros((len(seqs), WINDOW), np.int64)
    for i, s in enumerate(seqs):
        pad[i, : len(s)] = s
    live = np.arange(WINDOW)[None] < n[:, None]
    own = np.zeros((k, k))  # moves that were seen
    seen = np.zeros((len(seqs), WINDOW, k))
    for i, labels in enumerate(gold):
        seen[i, np.arange(len(labels)), labels] = 1
        np.add.at(own, (labels[:-1], labels[1:]), 1)
    m1, m2 = [np.zeros_like(weights), np.zeros_like(trans)], [np.zeros_like(weights), np.zeros_like(trans)]
    for step in range(1, rounds + 1):
        score = np.add.reduceat(weights[flat], starts) * scale[:, None]
        u = score[pad]
        e = np.exp(u - u.max(2, keepdims=True))
        move = np.exp(trans - trans.max())
        alpha, beta = np.empty_like(e), np.ones_like(e)
        alpha[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
        for t in range(1, WINDOW):
            a = (alpha[:, t - 1] @ move) * e[:, t]
            alpha[:, t] = a / a.sum(1, keepdims=True)
        for t in range(WINDOW - 2, -1, -1):
            b = (e[:, t + 1] * beta[:, t + 1]) @ move.T
            beta[:, t] = np.where(live[:, t + 1, None], b / b.sum(1, keepdims=True), 1)
        marg = alpha * beta
        marg /= marg.sum(2, keepdims=True)
        off = (seen - marg) * live[:, :, None]
        by_word = np.stack([np.bincount(pad.ravel(), off[:, :, y].ravel(), len(feats)) for y in range(k)], 1) * scale[:, None]
        grad_w = np.stack([np.bincount(flat, by_word[of, y], BUCKETS) for y in range(k)], 1) / len(seqs) - decay * weights
        pairs = np.zeros((k, k))
        for t in range(1, WINDOW):
            p = alpha[:, t - 1, :, None] * move[None] * (e[:, t] * beta[:, t])[:, None, :]
            p /= p.sum((1, 2), keepdims=True)
            pairs += (p * live[:, t, None, None]).sum(0)
        grad_t = (own - pairs) / len(seqs) - 1e-2 * trans
        for x, g, a, b in ((weights, grad_w, m1, m2), (trans, grad_t, m1, m2)):
            j = int(x is trans)
            a[j] = 0.9 * a[j] + 0.1 * g
            b[j] = 0.99 * b[j] + 0.01 * g * g
            x += (rate * (a[j] / (1 - 0.9**step)) / (np.sqrt(b[j] / (1 - 0.99**step)) + 1e-7)).astype(x.dtype)
    return Chain(languages, weights, trans)


def labelled_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int, words_each: int, most_rows: int) -> list[tuple[str | None, str]]:
    """The bounded training sample: rows per language in hash order, first words only."""
    w = Window.partitionBy("lang").orderBy("h", "key", "text")
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    languages = labelled.agg(F.count_distinct(lang_col)).first()[0]
    per_language = max(1, min(per_language, most_rows // max(1, languages)))
    rows = (
        labelled
        .select(F.xxhash64(F.col(id_col).cast("string")).alias("h"), F.col(id_col).cast("string").alias("key"), F.col(lang_col).alias("lang"), F.substring(F.col(text_col).cast("string"), 1, words_each * 12).alias("text"))
        .withColumn("r", F.row_number().over(w))
        .where(F.col("r") <= per_language)
        .orderBy("lang", "r")
        .select("text", "lang")
        .collect()
    )
    return [(r.text, r.lang) for r in rows]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 300, words_each: int = 64, most_rows: int = 60_000) -> Chain:
    return fit(labelled_sample(docs, id_col, text_col, lang_col, per_language, words_each, most_rows), words_each)


_LIVE: dict[str, Chain] = {}


def label(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``lang_pred`` and ``score`` for every row; ``carry`` names columns to keep.

    No shuffle: the model (a table of fixed size) is broadcast and each batch of
    texts is labelled where it is read.
    """
    spark = docs.sparkSession
    key = uuid.uuid4().hex  # workers keep a model by this name
    held = spark.sparkContext.broadcast((key, chain.languages, chain.weights, chain.transitions))
    keep = carry if carry is not None else [id_col]
    # a text that is carried is not sent twice
    at_text = keep.index(text_col) if text_col in keep and docs.schema[text_col].dataType == StringType() else len(keep)
    fields = [docs.select(F.col(f"`{c}`")).schema[0] for c in keep]
    names = [f"c{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("langid", _LIVE.clear)
        own = held.value
        if own[0] not in _LIVE:
            _LIVE.clear()
            _LIVE[own[0]] = Chain(*own[1:])
        model = _LIVE[own[0]]
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                langs, scores = model.predict(part.column(at_text).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*names, "lang_pred", "score"])
        settle()

    text = [F.col(text_col).cast("string").alias("t")] if at_text == len(keep) else []
    slim = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], *text)
    kinds = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, fields))
    out = slim.mapInArrow(run, f"{kinds}, lang_pred string, score double")
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], "lang_pred", "score")


def held_out(id_col: str = "doc_id"):
    """Documents kept from training: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
