"""BPE encoding and decoding: speculate, verify, and merge exactly only what fails.

Every distinct pre-token is first cut greedily into the longest vocabulary entries. A cut is right when
all its adjacent pairs are *compatible*: merging the two entries' bytes gives back just these two entries. That is checked for
all pairs of a batch at once, in arrays: both entries are taken apart step by step, the later merge first, and at no step may the two
pieces that meet at the border have a merge of their own that comes before the next one in either entry. Pre-tokens with an
incompatible pair, or with a piece that merging would not build, are merged exactly by rank. The check holds for vocabularies in which
each entry has one merge, later than those of its parts; with any other, all pre-tokens are merged exactly.

Null texts count as empty; an empty text has no tokens and decodes to an empty text. Repeated rows each give a row.
Columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Callable
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import few, kept, map_arrow, table, text_of

#: The split pattern of byte-level BPE, with {L} letters, {N} numbers, {S} white space, {O} all else.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?{O}+|{S}+(?!{T})|{S}+"
#: Words kept in a worker's cache at most (some 30 MB); beyond that it starts anew.
CACHE_WORDS = 150_000
#: Bytes of a word beyond which it is handled alone.
LONG = 1000
#: The rank of what never merges.
NEVER = np.iinfo(np.int64).max
#: Below this code point the classes are spelt out, so that the faster of two regex engines can be used.
LATIN_END = 0x250


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of byte-level BPE: visible Latin-1 characters stand for themselves, others follow from 256."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=1)
def _latin_pattern() -> re.Pattern:
    letters = numbers = spaces = ""
    for c in map(chr, range(LATIN_END)):
        kind = unicodedata.category(c)[0]
        if c.isspace() and not "\x1c" <= c <= "\x1f":
            spaces += re.escape(c)
        elif kind == "L":
            letters += re.escape(c)
        elif kind == "N":
            numbers += re.escape(c)
    return re.compile(SPLIT.format(L=f"[{letters}]", N=f"[{numbers}]", S=f"[{spaces}]", T=f"[^{spaces}]", O=f"[^{spaces}{letters}{numbers}]"))


@lru_cache(maxsize=1)
def _any_pattern():
    import regex

    return regex.compile(SPLIT.format(L=r"\p{L}", N=r"\p{N}", S=r"\p{White_Space}", T=r"\P{White_Space}", O=r"[^\p{White_Space}\p{L}\p{N}]"))


_ASCII = re.compile(SPLIT.format(L="[A-Za-z]", N="[0-9]", S=r"\s", T=r"\S", O=r"[^\sA-Za-z0-9]").encode())
_BEYOND = re.compile(f"[^\x00-{chr(LATIN_END - 1)}]")


def _packed(words: list[bytes], flat: np.ndarray, sizes: np.ndarray) -> dict[bytes, bytes]:
    """words -> their ids in flat, packed."""
    raw, stops = flat.astype("<u4").tobytes(), (4 * np.cumsum(sizes)).tolist()
    return {w: raw[a:b] for w, a, b in zip(words, [0, *stops[:-1]], stops, strict=True)} if words else {}


class Codec:
    """A byte-level BPE vocabulary. encode_all() and decode() are exact; see the module's text for how."""

    def __init__(self, definition: str):
        d = json.loads(definition)
        alphabet = byte_alphabet()
        self.special = {x["content"]: x["id"] for x in d["added_tokens"]}
        self.vocab = {bytes(map(alphabet.__getitem__, token)): i for token, i in d["model"]["vocab"].items()}
        self.bytes = {i: token for token, i in self.vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        self._merges = [tuple(bytes(map(alphabet.__getitem__, x)) for x in (m if isinstance(m, list) else m.split(" "))) for m in d["model"]["merges"]]

    @cached_property
    def encoder(self) -> Encoder:
        encoder = Encoder(self.vocab, self._merges, self.special)
        self._merges = []
        return encoder

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        return self.encoder.encode_all(texts)

    def decode(self, packed: bytes) -> str:
        ids = np.frombuffer(packed, "<u4").tolist()
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


class Encoder:
    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]], special: dict[str, int]):
        self.special = special
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        self.byte_ids = [vocab.get(bytes([b])) for b in range(256)]
        self.vocab, self.longest = vocab, max(map(len, vocab))
        # beginnings of entries as a tree in arrays: (node, byte) -> node, and of each node its entry, or -1
        ids = {token[:n]: -1 for token in vocab for n in range(1, len(token))} | vocab
        nodes = {b"": 0} | {prefix: i for i, prefix in enumerate(ids, 1)}
        steps = np.fromiter((nodes[prefix[:-1]] << 8 | prefix[-1] for prefix in ids), np.int64, len(ids))
        order = np.argsort(steps)
        self.step_keys, self.step_nodes = np.append(steps[order], NEVER), np.append(order + 1, 0)
        self.entry = np.append([-1], np.fromiter(ids.values(), np.int64, len(ids)))
        del ids, nodes
        self.cut_at = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.words: dict = {}
        # merges as arrays: ranks by pair, and of each entry the parts and the rank that makes it (-1: a byte)
        pairs = np.array([(a, b, new) for (a, b), (_, new) in self.merges.items()], np.int64).reshape(-1, 3)
        ranks = np.fromiter((rank for rank, _ in self.merges.values()), np.int64, len(self.merges))
        keys = pairs[:, 0] << 32 | pairs[:, 1]
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = np.append(keys[order], NEVER), np.append(ranks[order], NEVER)
        self.made = np.zeros(len(ranks) + 1, np.int64)
        self.made[ranks] = pairs[:, 2]
        size = max(vocab.values()) + 1
        self.left, self.right, self.birth = np.zeros(size, np.int64), np.zeros(size, np.int64), np.full(size, -1, np.int64)
        self.left[pairs[:, 2]], self.right[pairs[:, 2]], self.birth[pairs[:, 2]] = pairs[:, 0], pairs[:, 1], ranks
        self.byte_entries = np.array([-1 if i is None else i for i in self.byte_ids], np.int64)
        single = np.zeros(size, bool)
        single[[i for i in self.byte_ids if i is not None]] = True
        #: Whether entries are made by one merge each, after those of their parts.
        self.orderly = len(np.unique(pairs[:, 2])) == len(pairs) and not single[pairs[:, 2]].any() and bool((self.birth[pairs[:, :2]] < ranks[:, None]).all())
        #: Entries that merging their own bytes gives back.
        self.whole = single
        if self.orderly:
            own = self.apart(pairs[:, 0], pairs[:, 1], ranks)
            for (a, b, new), ok in zip(pairs.tolist(), own.tolist(), strict=True):  # parts come first
                self.whole[new] = ok and self.whole[a] and self.whole[b]

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the merges of pairs; NEVER where there is none."""
        keys = left << 32 | right
        at = np.searchsorted(self.pair_keys[:-1], keys)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NEVER)

    def apart(self, left: np.ndarray, right: np.ndarray, before: np.ndarray) -> np.ndarray:
        """For arrays of adjacent ids, whether no merge crosses their border before the given ranks, from the bytes on."""
        out = np.ones(len(left), bool)
        at, x, y, before = np.arange(len(left)), left.copy(), right.copy(), before.copy()
        while len(at):
            crosses = self.rank_of(x, y) < before
            out[at[crosses]] = False
            own, other = self.birth[x], self.birth[y]
            on = ~crosses & ((own >= 0) | (other >= 0))
            # the later merge is undone; of equal merges the left one came first, so a merge across may equal the right one's rank
            first = own > other
            before = np.where(first, own, other + 1)[on]
            x, y = np.where(first, self.right[x], x)[on], np.where(first, y, self.left[y])[on]
            at = at[on]
        return out

    def merge(self, word: bytes) -> list[int]:
        """Exact merging by rank, with a heap of the adjacent pairs: n log n for a word of n bytes."""
        ids = [self.byte_ids[b] for b in word]
        n, merges = len(ids), self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(merges[p][0], i, p) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in merges]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if ids[i] is None or j >= n or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j] = merges[pair][1], None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (p := (ids[i], ids[k])) in merges:
                    heapq.heappush(heap, (merges[p][0], i, p))
            if (h := before[i]) >= 0 and (p := (ids[h], ids[i])) in merges:
                heapq.heappush(heap, (merges[p][0], h, p))
        return [x for x in ids if x is not None]

    def merge_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """merge() of many words at once: ids of all, and how many each has. Round by round every word merges its pair of least rank,
        wherever it stands; in an orderly vocabulary no merge makes room for one of lower rank."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        x = self.byte_entries[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), size)
        done_ids, done_owner = [], []
        rank = np.full(len(x), NEVER)
        at = np.flatnonzero(owner[1:] == owner[:-1])
        rank[at] = self.rank_of(x[at], x[at + 1])
        while len(x):
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            counts = np.diff(np.append(starts, len(x)))
            least = np.repeat(np.minimum.reduceat(rank, starts), counts)
            ended = least == NEVER
            if ended.any():
                done_ids.append(x[ended])
                done_owner.append(owner[ended])
                x, owner, rank, least = x[~ended], owner[~ended], rank[~ended], least[~ended]
                if not len(x):
                    break
            hit = np.flatnonzero(rank == least)
            # of pairs that overlap, as in a run of one entry, every second one from the left
            run = np.append(True, np.diff(hit) != 1)
            hit = hit[(hit - hit[run][np.cumsum(run) - 1]) % 2 == 0]
            x[hit] = self.made[rank[hit]]
            stays = np.ones(len(x), bool)
            stays[hit + 1] = False
            new = (np.cumsum(stays) - 1)[hit]
            x, owner, rank = x[stays], owner[stays], rank[stays]
            at = np.unique(np.append(new, new[new > 0] - 1))
            rank[at] = NEVER
            at = at[at + 1 < len(x)]
            at = at[owner[at] == owner[at + 1]]
            rank[at] = self.rank_of(x[at], x[at + 1])
        ids, owners = (np.concatenate(done_ids), np.concatenate(done_owner)) if done_ids else (x, owner)
        order = np.argsort(owners, kind="stable")
        return ids[order], np.bincount(owners, minlength=len(words))

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        out, at, get = [], 0, self.vocab.get
        while at < len(word):
            end = next(e for e in range(min(len(word), at + self.longest), at, -1) if get(word[at:e]) is not None)
            out.append(get(word[at:end]))
            at = end
        return out

    def propose_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """propose() of many words at once, a byte of each at a time: ids of all, and how many each has."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        stop = np.cumsum(size)
        word = np.flatnonzero(size)
        stop, at = stop[word], (stop - size)[word]
        node, best, after = np.zeros(len(word), np.int64), np.full(len(word), -1), at.copy()
        found_ids, found_words = [], []
        while len(word):
            inside = at < stop
            keys = node << 8 | data[np.minimum(at, len(data) - 1)]
            place = np.searchsorted(self.step_keys[:-1], keys)
            goes = inside & (self.step_keys[place] == keys)
            node = np.where(goes, self.step_nodes[place], 0)
            at = at + goes
            entry = self.entry[node]
            known = goes & (entry >= 0)
            best, after = np.where(known, entry, best), np.where(known, at, after)
            stuck = np.flatnonzero(~goes)
            if len(stuck):
                found_ids.append(best[stuck])
                found_words.append(word[stuck])
                at[stuck], best[stuck] = after[stuck], -1
                rest = at < stop
                if not rest.all():
                    on = rest | goes
                    word, stop, at, node, best, after = (v[on] for v in (word, stop, at, node, best, after))
        if not found_ids:
            return np.zeros(0, np.int64), size
        owners = np.concatenate(found_words)
        order = np.argsort(owners, kind="stable")
        return np.concatenate(found_ids)[order], np.bincount(owners, minlength=len(words))

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For arrays of adjacent whole entries, whether each pair stays as it is when its bytes are merged."""
        keys, inverse = np.unique(left << 32 | right, return_inverse=True)
        return self.apart(keys >> 32, keys & 0xFFFFFFFF, np.full(len(keys), NEVER))[inverse]

    def learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of distinct words, packed as little-endian unsigned 32-bit integers."""
        if not self.orderly:
            return {w: np.array(self.merge(w), "<u4").tobytes() for w in words}
        out = {w: self._learn_long(w) for w in words if len(w) > LONG}
        words = [w for w in words if len(w) <= LONG]
        flat, sizes = self.propose_all(words)
        owner = np.repeat(np.arange(len(words)), sizes)
        fails = self._fails(flat, owner, len(words))
        out |= _packed([w for w, bad in zip(words, fails.tolist(), strict=True) if not bad], flat[~fails[owner]], sizes[~fails])
        failing = [w for w, bad in zip(words, fails.tolist(), strict=True) if bad]
        return out | _packed(failing, *self.merge_all(failing))

    def _fails(self, flat: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Which of n words have a piece that isn't whole, or an incompatible pair."""
        fails = np.zeros(n, bool)
        fails[owner[~self.whole[flat]]] = True
        same = (owner[1:] == owner[:-1]) & ~fails[owner[1:]]
        fails[owner[1:][same][~self.compatible(flat[:-1][same], flat[1:][same])]] = True
        return fails

    def _learn_long(self, word: bytes) -> bytes:
        """The same for a word of very many bytes, alone."""
        flat = np.array(self.propose(word), np.int64)
        if self._fails(flat, np.zeros(len(flat), np.int64), 1)[0]:
            flat = np.array(self.merge(word), np.int64)
        return flat.astype("<u4").tobytes()

    def _pieces(self, text: str) -> list:
        if text.isascii():
            return _ASCII.findall(text.encode())
        return (_any_pattern() if _BEYOND.search(text) else _latin_pattern()).findall(text)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        split = []  # of each text: lists of pieces, or ids of special tokens
        for text in texts:
            if self.cut_at is not None and any(s in text for s in self.special):
                split.append([self.special[p] if p in self.special else self._pieces(p) for p in self.cut_at.split(text) if p])
            else:
                split.append([self._pieces(text)])
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        words = self.words
        new = {w for parts in split for p in parts if not isinstance(p, int) for w in p if w not in words}
        if new:
            raw = {w: w if isinstance(w, bytes) else w.encode() for w in new}
            learnt = self.learn(list(dict.fromkeys(raw.values())))
            self.words.update({w: learnt[b] for w, b in raw.items()})
        get = self.words.__getitem__
        return [b"".join([p.to_bytes(4, "little") if isinstance(p, int) else b"".join(map(get, p)) for p in parts]) for parts in split]


def _shared(spark: SparkSession, path: str) -> Callable[[], Codec]:
    """The vocabulary (a few MB whatever the data) goes from the driver to all executors; each worker keeps one codec of it."""
    with open(path, encoding="utf-8") as f:
        definition = f.read()
    key, shared = hashlib.sha256(definition.encode()).hexdigest(), spark.sparkContext.broadcast(definition)
    return lambda: kept(key, lambda: Codec(shared.value))


def bpe_encode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, ids (packed little-endian unsigned 32-bit) of every whole text. vocabulary: path of a tokenizer file."""
    codec = _shared(df.sparkSession, vocabulary)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = codec().encode_all(batch.column(1).to_pylist())
        return pa.record_batch([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=[id_col, "n_tokens", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_arrow(df.select(id_col, text_of(text_col).alias("text")), run, f"`{id_col}` {kind}, n_tokens long, ids binary")


def bpe_decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """The columns of bpe_encode()'s result and the decoded text. Null ids decode to an empty text."""
    codec = _shared(encoded.sparkSession, vocabulary)
    names = encoded.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = codec()
        texts = [own.decode(x) if x else "" for x in batch.column(names.index("ids")).to_pylist()]
        return pa.record_batch([*batch.columns, pa.array(texts, pa.string())], names=[*names, "decoded"])

    return map_arrow(encoded, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema) + ", decoded string")


def bpe_round_trip(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What bpe_decode() gives for bpe_encode()'s result, in one pass: a worker decodes what it has just encoded, so a task has one worker."""
    codec = _shared(df.sparkSession, vocabulary)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = codec()
        ids = own.encode_all(batch.column(1).to_pylist())
        decoded = pa.array([own.decode(x) if x else "" for x in ids], pa.string())
        return pa.record_batch([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), decoded], names=[id_col, "n_tokens", "ids", "decoded"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_arrow(df.select(id_col, text_of(text_col).alias("text")), run, f"`{id_col}` {kind}, n_tokens long, ids binary, decoded string")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode all documents, decode the ids again, and return digests of both."""
    both = bpe_round_trip(few(table(spark, sf_dir, "documents")), default_vocabulary())
    return both.select("doc_id", "n_tokens", F.sha2(F.col("ids"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
