"""BPE encoding and decoding by a deterministic tokenization automaton.

The merges of a tokenizer file are compiled by successive merge gadgets. The
automaton reads tokens; at first it has one state in which every base symbol
loops. Merge ``k`` of ``(u, v)`` into ``uv`` applies one gadget:

* the state that ``u`` leads to is copied without its ``v`` arc, and every ``u``
  arc is led to the copy,
* every state with a ``u`` arc gets a ``uv`` arc into the state that ``v`` led to,
* where that state has no ``v`` arc any more, ``u`` and ``v`` never meet: the gadget adds
  nothing, and ``uv`` is no label of the automaton.

By induction a token leads to the same state wherever it is read, so a state is
the pair (token that owns the copies, number of gadgets applied), and whether a
state has an arc follows from the cuts made in it before that arc was born. Spelled
out, the table would have one cell for each two tokens (2.4 billion); compiled, it
keeps for each state the arcs that were cut, and ``has_arc`` answers from these
cuts and remembers.

A string has exactly one accepted token sequence, and each of its prefixes too,
so encoding a word is a left-to-right walk over arcs whose labels spell it.
Decoding emits the labels of the arcs.

Null text is the empty text: 0 tokens and the digests of empty strings. Long
texts are encoded whole; repeated rows give repeated rows; an empty table gives
an empty table. Columns of the input that are not asked for are ignored, so
clashing names do no harm.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.worker import Memo, enter, settle

WORD_END = "</w>"
NEVER = 1 << 60
#: Words of a generation whose encoding a worker remembers, and arcs it remembers.
CACHE_WORDS = 60_000
CACHE_ARCS = 150_000


def byte_symbols() -> list[str]:
    """The printable symbol that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b] = chr(0x100 + extra)
            extra += 1
    return out


class MergeAutomaton:
    """Compiled merges: arcs, states and labels."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int] | None = None):
        size = max([*vocab.values(), *(special or {}).values()], default=-1) + 1
        self.labels = [""] * size
        for token, i in [*vocab.items(), *(special or {}).items()]:
            self.labels[i] = token
        self.left = [-1] * size  # token whose arcs bore this token's arcs
        self.owner = [-1] * size  # token whose state this token was led to
        self.born = [-1] * size  # gadget that made this token
        self.cuts: list[dict[int, int]] = [{} for _ in range(size)]  # cuts[u][v]: gadget that cut v after u
        self.parts: set[int] = set()
        self.ids = {t: i for t, i in vocab.items() if len(t.removesuffix(WORD_END)) == 1}  # labels of arcs
        for k, (u, v) in enumerate(merges):
            self.gadget(k, vocab[u], vocab[v], vocab[u + v])
        self.reach: dict[str, int] = {}  # symbols of the longest label, by its first two
        for t in self.ids:
            plain = t.removesuffix(WORD_END)
            self.reach[plain[:2]] = max(len(plain), self.reach.get(plain[:2], 1))
        self.arcs: dict[int, bool] = {}
        self.size = size

    def gadget(self, k: int, u: int, v: int, uv: int) -> None:
        if uv in self.parts:
            raise ValueError(f"merge {k} makes a token that an earlier merge uses")
        self.parts |= {u, v}
        if self.labels[u] not in self.ids or self.labels[v] not in self.ids or not self._derive(u, v):
            return
        if self.born[uv] >= 0:
            raise ValueError(f"merge {k} makes a token a second time")
        self.ids[self.labels[uv]] = uv
        self.cuts[u].setdefault(v, k)
        self.left[uv], self.owner[uv], self.born[uv] = u, v, k

    def has_arc(self, state: int, token: int) -> bool:
        """Whether the state that token ``state`` leads to has an arc for ``token``."""
        key = state * self.size + token
        known = self.arcs.get(key)
        if known is None:
            if len(self.arcs) >= CACHE_ARCS:
                self.arcs.clear()
            known = self.arcs[key] = self._derive(state, token)
        return known

    def _derive(self, state: int, token: int) -> bool:
        until = NEVER  # gadgets that the current owner's state had seen when it was copied
        while state >= 0:
            cuts, arc, heir = self.cuts[state], token, NEVER
            while arc >= 0:
                k = cuts.get(arc)
                if k is not None and k < until and k <= heir:
                    return False
                heir, arc = self.born[arc], self.left[arc]
            until, state = self.born[state], self.owner[state]
        return True

    def encode(self, symbols: str) -> list[int]:
        """Tokens of one word, given as its base symbols; the last one takes the word end.

        Walks the arcs depth first, longest label first. A (state, place) from which
        the end wasn't reached is never entered again, so the walk is linear in
        the arcs it looks at; the accepted path is unique.
        """
        ids, n, has_arc = self.ids, len(symbols), self.has_arc
        path: list[int] = []
        ends: list[int] = []
        tried: list[int] = []  # next end to try at each depth
        dead: set[tuple[int, int]] = set()
        at, state, end = 0, -1, min(n, self.reach.get(symbols[:2], 1))
        while True:
            token = None
            while end > at:
                token = ids.get(symbols[at:end] if end < n else symbols[at:] + WORD_END)
                if token is not None and (state < 0 or has_arc(state, token)) and (end == n or (token, end) not in dead):
                    break
                token = None
                end -= 1
            if token is None:
                dead.add((state, at))
                state_was = path.pop()
                end = tried.pop()
                ends.pop()
                at, state = (ends[-1], path[-1]) if ends else (0, -1)
                assert state_was >= 0
                continue
            path.append(token)
            if end == n:
                return path
            ends.append(end)
            tried.append(end - 1)
            at, state = end, token
            end = min(n, at + self.reach.get(symbols[at : at + 2], 1))


class WordTokenizer:
    """Normalises, splits and encodes whole texts as the tokenizer file says.

    Supports files of the kind "NFC, white space to a space, lower case; pattern
    split; byte level; BPE with a word end". Strings of special tokens in a text
    are those tokens.
    """

    def __init__(self, spec: str):
        conf = json.loads(spec)
        model = conf["model"]
        kinds = [n["type"] for n in conf["normalizer"]["normalizers"]]
        split = conf["pre_tokenizer"]["pretokenizers"][0]
        if kinds != ["NFC", "Replace", "Lowercase"] or model["end_of_word_suffix"] != WORD_END or not split["invert"]:
            raise ValueError("unsupported tokenizer file")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in conf["added_tokens"]}
        self.automaton = MergeAutomaton(model["vocab"], merges, self.special)
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.symbols = byte_symbols()
        self.words = Memo(self.word, CACHE_WORDS)
        self.packed = [i.to_bytes(4, "little") for i in range(self.automaton.size)]
        self.bytes_of = {s: i.to_bytes(4, "little") for s, i in self.special.items()}

    def word(self, w: str) -> bytes:
        symbols = "".join(map(self.symbols.__getitem__, w.encode("utf-8", "replace")))
        return b"".join(map(self.packed.__getitem__, self.automaton.encode(symbols)))

    def pieces(self, text: str) -> list[bytes]:
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # lower case letter by letter, without the rule for a final sigma
                text = text.replace("Σ", "σ")
        return list(map(self.words.__getitem__, self.pattern.findall(text.lower())))

    def encode(self, text: str | None) -> bytes:
        """Ids of the whole text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.cut is None or "<|" not in text:
            return b"".join(self.pieces(text))
        out: list[bytes] = []
        for i, part in enumerate(self.cut.split(text)):
            out += [self.bytes_of[part]] if i % 2 else self.pieces(part)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Labels of the arcs, in order, a space between."""
        return " ".join(map(self.automaton.labels.__getitem__, memoryview(ids).cast("I")))


_LOADED: dict[int, WordTokenizer] = {}


def _tokenizer(held) -> WordTokenizer:
    """One compiled automaton for each worker process and tokenizer file."""
    key = held.value[0]
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = WordTokenizer(held.value[1])
    return _LOADED[key]


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_decode(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, keep_decoded: bool = False
) -> DataFrame:
    """Encode every whole text and decode the ids again.

    Returns the id column, ``n_tokens``, ``ids_sha256`` (of the ids as
    little-endian unsigned 32-bit integers) and ``decoded_sha256`` (of the
    decoded text in UTF-8); with ``keep_ids`` also ``ids`` (array of int) and
    with ``keep_decoded`` also ``decoded``. The tokenizer file (a vocabulary of
    fixed size, under 2 MB) is read on the driver and broadcast; each worker
    compiles it once. No shuffle. Text that isn't well-formed cannot occur in a
    Spark string column.
    """
    spark: SparkSession = docs.sparkSession
    spec = read_spec(tokenizer_path)
    held = spark.sparkContext.broadcast((hash(spec), spec))
    extra = ", ids array<int>" * keep_ids + ", decoded string" * keep_decoded
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("bpe", _LOADED.clear)
        tok = _tokenizer(held)
        for batch in batches:
            n, ids_sha, text_sha, ids_out, text_out = [], [], [], [], []
            for text in batch.column(1):
                ids = tok.encode(text.as_py())
                back = tok.decode(ids)
                n.append(len(ids) // 4)
                ids_sha.append(sha256(ids).hexdigest())
                text_sha.append(sha256(back.encode("utf-8")).hexdigest())
                if keep_ids:
                    ids_out.append(list(memoryview(ids).cast("I")))
                if keep_decoded:
                    text_out.append(back)
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                cols.append(pa.array(ids_out, pa.list_(pa.int32())))
                names.append("ids")
            if keep_decoded:
                cols.append(pa.array(text_out, pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(cols, names)
        settle()

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = slim.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}")
    return out.withColumnRenamed("id", id_col)
