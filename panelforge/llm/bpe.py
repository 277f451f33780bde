"""BPE encoding and decoding with batched numpy merge rounds.

The vocabulary file is the public JSON form of a word-level BPE: text is
composed (NFC), lower-cased, cut at white space, split by a pattern, mapped to
byte symbols, and merged with a word-end suffix.

White space never lies inside a token, so texts are cut at white space first
and each distinct chunk is encoded once for each worker: the missing chunks of
a batch of texts are merged together. All their symbols stand in one flat
array. In each round the keys of adjacent pairs are looked up by binary search
in the sorted pair keys of the merge list, each word takes its lowest rank, and
the pairs of that rank are merged in all words at once.

A word of more than ``LONG`` bytes (unspaced scripts, base64, minified code) would
need a round over all its symbols for each of its ranks. Such words are merged with
the places of each rank kept in a list: a round takes the lowest rank, merges its
places together, and looks up only the pairs beside them.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from .common import by_row, unused


@lru_cache(maxsize=1)
def later_characters() -> re.Pattern:
    """Characters that Unicode 3.2 hasn't assigned: tables of different ages may not agree on them."""
    old = unicodedata.ucd_3_2_0.category
    free = [c for c in range(128, 0x110000) if old(chr(c)) == "Cn" and not 0xD800 <= c < 0xE000]
    edges = [c for i, c in enumerate(free) if not i or free[i - 1] != c - 1], [c for i, c in enumerate(free) if i + 1 == len(free) or free[i + 1] != c + 1]
    return re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(*edges)) + "]")


NO_RANK = np.int64(1) << 40
#: Bytes above which a word's pairs are kept in lists by rank.
LONG = 256
#: White space of Unicode; Python's split also cuts at these four separators, which are symbols here.
SEPARATORS = re.compile("[\x1c-\x1f]")
UNICODE_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself, or the next free code point from 256."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    out, free = [], 256
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(free))
            free += 1
    return out


class WordBpe:
    """An encoder for one vocabulary file; made once for each worker by ``load``.

    ``encode`` gives for each chunk of a text a piece: the tuple of its ids or,
    with ``as_text``, (number of ids, ids as text, decoded text). Pieces are
    kept for up to ``cache`` chunks.
    """

    def __init__(self, path: str, as_text: bool = False, cache: int = 120_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        # Texts with characters that not all tables know are composed, lower-cased and split by the tables of the library.
        self.later = later_characters()
        self.composed, self.lowered = normalizers.NFC(), normalizers.Lowercase()
        self.splitter = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        self.special_split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        symbols = byte_symbols()
        self.byte_id = np.array([vocab[s] for s in symbols])
        self.last_id = np.array([vocab[s + suffix] for s in symbols])
        self.size = max(vocab.values()) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right = np.array([[vocab[a], vocab[b]] for a, b in pairs]).T
        made = np.array([vocab[a + b] for a, b in pairs])
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], np.arange(len(keys))[order], made
        # A merge is safe for all its places at once if its result takes part in later merges only.
        first_use = np.full(self.size, len(keys))
        np.minimum.at(first_use, left, np.arange(len(keys)))
        np.minimum.at(first_use, right, np.arange(len(keys)))
        self.safe = first_use[made] > np.arange(len(keys))
        self.as_text, self.limit = as_text, cache
        self.id_text = {i: str(i) for i in self.tokens}
        self.chunks: dict[str, tuple] = {}

    def merge(self, words: list[bytes]) -> tuple[list[int], list[int]]:
        """All ids in one list, and where each word's ids end."""
        if max(map(len, words)) <= LONG:
            return self.merge_rounds(words)
        short = [w for w in words if len(w) <= LONG]
        ids, ends = self.merge_rounds(short) if short else ([], [])
        pieces = iter([ids[a:b] for a, b in zip([0, *ends], ends)])
        out = [next(pieces) if len(w) <= LONG else self.merge_long(w) for w in words]
        return [i for piece in out for i in piece], np.cumsum([len(piece) for piece in out]).tolist()

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NO_RANK for one that is never merged."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NO_RANK)

    def merge_long(self, word: bytes) -> list[int]:
        """The ids of one word, in rounds that touch only the places of the lowest rank and the pairs beside them."""
        flat = np.frombuffer(word, dtype=np.uint8)
        sym = self.byte_id[flat]
        sym[-1] = self.last_id[flat[-1]]
        n = len(sym)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank = np.append(self.ranks(sym[:-1], sym[1:]), NO_RANK)
        places: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def note(at: np.ndarray) -> None:
            at = at[rank[at] < NO_RANK]
            at = at[np.argsort(rank[at], kind="stable")]
            firsts = np.flatnonzero(np.diff(rank[at], prepend=-1))
            for r, part in zip(rank[at[firsts]].tolist(), np.split(at, firsts[1:])):
                if r not in places:
                    places[r] = []
                    heappush(queue, r)
                places[r].append(part)

        note(np.arange(n))
        while queue:
            r = heappop(queue)
            at = np.unique(np.concatenate(places.pop(r)))
            at = at[rank[at] == r]
            if not len(at):
                continue
            if self.safe[r]:
                # Overlapping places (a run of one symbol): every second of the run.
                fresh = np.r_[True, after[at[:-1]] != at[1:]]
                run_start = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - run_start) % 2 == 0]
            else:
                note(at[1:])
                at = at[:1]
            gone = after[at]
            sym[at] = self.made[r]
            after[at] = after[gone]
            follow = after[at]
            before[follow[follow < n]] = at[follow < n]
            rank[gone] = NO_RANK
            touched = np.unique(np.concatenate([at, before[at]]))
            touched = touched[touched >= 0]
            paired = after[touched] < n
            rank[touched[~paired]] = NO_RANK
            touched = touched[paired]
            rank[touched] = self.ranks(sym[touched], sym[after[touched]])
            note(touched)
        at, out = 0, []
        while at < n:
            out.append(at)
            at = int(after[at])
        return sym[out].tolist()

    def merge_rounds(self, words: list[bytes]) -> tuple[list[int], list[int]]:
        """merge for words of bounded length: all of them together, a rank of each word in a round."""
        lengths = np.array([len(w) for w in words])
        ends = np.cumsum(lengths)
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        sym = self.byte_id[flat]
        sym[ends - 1] = self.last_id[flat[ends - 1]]
        word = np.repeat(np.arange(len(words)), lengths)
        done_sym, done_word = [], []
        while len(sym):
            rank = np.full(len(sym), NO_RANK)
            inner = np.flatnonzero(word[:-1] == word[1:])
            rank[inner] = self.ranks(sym[inner], sym[inner + 1])
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, starts)
            counts = np.diff(np.r_[starts, len(sym)])
            live = np.repeat(best < NO_RANK, counts)
            done_sym.append(sym[~live])
            done_word.append(word[~live])
            if not live.any():
                break
            chosen = live & (rank == np.repeat(best, counts))
            sym, word, rank, chosen = sym[live], word[live], rank[live], chosen[live]
            places = np.flatnonzero(chosen)
            # Overlapping places (a run of one symbol): every second of the run. Unsafe merges: the first of the word.
            fresh = np.r_[True, np.diff(places) != 1]
            run_start = np.maximum.accumulate(np.where(fresh, np.arange(len(places)), 0))
            keep = (np.arange(len(places)) - run_start) % 2 == 0
            first = np.r_[True, word[places[1:]] != word[places[:-1]]]
            keep &= self.safe[rank[places]] | first
            places = places[keep]
            sym = sym.copy()
            sym[places] = self.made[rank[places]]
            stay = np.ones(len(sym), bool)
            stay[places + 1] = False
            sym, word = sym[stay], word[stay]
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        sym = sym[np.argsort(word, kind="stable")]
        return sym.tolist(), np.cumsum(np.bincount(word, minlength=len(words))).tolist()

    def cut(self, text: str) -> list[str]:
        """Chunks of a text; those of special tokens begin with a space, which no other does."""
        if "<|" in text and self.special_split.search(text):
            out = []
            for i, part in enumerate(self.special_split.split(text)):
                out += [" " + part] if i % 2 else self.cut(part)
            return out
        if not text.isascii() and self.later.search(text):
            text = self.lowered.normalize_str(self.composed.normalize_str(text))
            return [c for c in UNICODE_SPACE.split(text) if c]
        if not text.isascii():
            # Lower-casing here is by character: a capital sigma is never final.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        return [c for c in UNICODE_SPACE.split(text) if c] if SEPARATORS.search(text) else text.split()

    def learn(self, missing: set[str]) -> None:
        words: dict[str, int] = {}
        whole, parts = [], {}
        for c in missing:
            later = not c.isascii() and self.later.search(c)
            if c.isalpha() and not later:
                words.setdefault(c, len(words))
                whole.append(c)
            elif c[0] != " ":
                split = [w for w, _ in self.splitter.pre_tokenize_str(c)] if later else self.split.findall(c)
                parts[c] = [words.setdefault(w, len(words)) for w in split]
        ids, ends = self.merge([w.encode() for w in words]) if words else ([], [])
        starts = [0, *ends]
        if self.as_text:
            shown = [self.id_text[i] for i in ids]
            done = [(b - a, " ".join(shown[a:b]), self.decode(ids[a:b])) for a, b in zip(starts, ends)]
        else:
            done = [tuple(ids[a:b]) for a, b in zip(starts, ends)]
        chunks = self.chunks
        for c in whole:
            chunks[c] = done[words[c]]
        for c, at in parts.items():
            got = [done[i] for i in at]
            if len(got) == 1:
                chunks[c] = got[0]
            elif self.as_text:
                chunks[c] = (sum([g[0] for g in got]), " ".join([g[1] for g in got]), " ".join([g[2] for g in got]))
            else:
                chunks[c] = sum(got, ())
        for c in missing:
            if c[0] == " ":
                i = self.special[c[1:]]
                chunks[c] = (1, str(i), self.decode([i])) if self.as_text else (i,)

    def encode(self, texts: list[str]) -> list[list[tuple]]:
        """For each text the pieces of its chunks."""
        cut = [self.cut(t) for t in texts]
        if len(self.chunks) > self.limit:
            self.chunks.clear()
        missing = {c for chunks in cut for c in chunks} - self.chunks.keys()
        if missing:
            self.learn(missing)
        get = self.chunks.__getitem__
        return [list(map(get, chunks)) for chunks in cut]

    def ids(self, text: str) -> list[int]:
        return [i for piece in self.encode([text])[0] for i in piece]

    def decode(self, ids: list[int]) -> str:
        """Without a decoder in the file, tokens are joined by a space."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


@lru_cache(maxsize=2)
def load(path: str, as_text: bool = False, cache: int = 120_000) -> WordBpe:
    return WordBpe(path, as_text, cache)


#: Characters that are encoded together, so that a batch's memory doesn't follow its longest texts.
GROUP_CHARS = 2_000_000


def _groups(texts: list[str]) -> Iterator[list[str]]:
    group, chars = [], 0
    for t in texts:
        group.append(t)
        chars += len(t)
        if chars >= GROUP_CHARS:
            yield group
            group, chars = [], 0
    if group:
        yield group


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "token_ids", decoded_col: str | None = None) -> DataFrame:
    """docs with the column ids_col, array<int>: the ids of each whole text.

    With decoded_col also the text that these ids decode to, from the same worker
    and its one copy of the tables. A null text is encoded as an empty one: no
    ids. Repeated rows and other columns pass through; columns of the two names
    are replaced.
    """
    new = {"ids": ids_col} | ({"decoded": decoded_col} if decoded_col else {})

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = load(path)
        for texts in batches:
            for group in _groups(["" if t is None else t for t in texts]):
                part = pd.DataFrame({"ids": [np.fromiter((i for p in pieces for i in p), np.int32) for pieces in bpe.encode(group)]})
                if decoded_col:
                    part["decoded"] = [bpe.decode(ids.tolist()) for ids in part["ids"]]
                yield part
        bpe.chunks.clear()  # the worker may go on to other tasks: it keeps the tables, not the pieces

    made = by_row(docs, run, "ids array<int>" + (", decoded string" if decoded_col else ""))(F.col(text_col))
    held = unused("made", docs.columns)
    rows = docs.withColumn(held, made).drop(*[c for c in new.values() if c in docs.columns])
    return rows.withColumns({c: F.col(held)[k] for k, c in new.items()}).drop(held)


def decode(tokens: DataFrame, path: str, ids_col: str = "token_ids", text_col: str = "decoded") -> DataFrame:
    """tokens with the column text_col: the text of the ids; null ids give an empty text."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = load(path)
        for lists in batches:
            yield pd.DataFrame({"text": [bpe.decode([] if ids is None else list(ids)) for ids in lists]})

    return tokens.withColumn(text_col, by_row(tokens, run, "text string")(F.col(ids_col))["text"])


def token_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text; null counts as empty."""
    from hashlib import sha256

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = load(path, as_text=True, cache=250_000)  # pieces are short texts here, and nothing else of the batch is kept
        for texts in batches:
            n, ids, decoded = [], [], []
            for group in _groups(texts.tolist()):
                for pieces in bpe.encode(group):
                    n.append(sum([p[0] for p in pieces]))
                    ids.append(sha256(" ".join([p[1] for p in pieces]).encode()).hexdigest())
                    decoded.append(sha256(" ".join([p[2] for p in pieces]).encode()).hexdigest())
            yield pd.DataFrame({"n_tokens": n, "ids_sha256": ids, "decoded_sha256": decoded})
        bpe.chunks.clear()

    made = by_row(rows, run, "n_tokens long, ids_sha256 string, decoded_sha256 string")
    return rows.select("doc_id", made("text").alias("made")).select("doc_id", "made.*")
