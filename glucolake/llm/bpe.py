"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

A text is cut at added special tokens, then into words by the tokenizer's pattern.  Each
distinct word starts as a row of byte symbols; the leaves of a segment tree hold the merge
rank of each adjacent pair, every inner node the least of its children, so the root yields
the lowest rank and, by going down to the left on ties, its leftmost place.  After a merge
three leaves change (the pair itself, the one before, the one after), each by a logarithmic
point update; the word is done when the root holds no mergeable pair.

Words of up to ``WIDE`` bytes are merged many at a time: one numpy row per word, the same
tree as columns.  Longer ones use the same tree for a single word.

Nulls count as empty; an empty text has no ids.  Rows are independent, so ties, repeated
rows and empty tables need no rule.  Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from glucolake.llm.shared import batched, steps

#: Fixed value: the word pattern of byte-level BPE tokenizers of this family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WIDE = 32
NO_RANK = np.int32(1 << 30)
#: Bytes of words that a worker keeps with their ids, in two generations; when the younger has half of them it becomes the older, which goes.  What a word takes besides its bytes.
MEMORY_BYTES, WORD_BYTES = 64 << 20, 300


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files, by rule: visible Latin-1 stays, the rest goes to 256 and up."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


@functools.cache
def latin_words() -> re.Pattern:
    """``PATTERN`` for texts in Latin-1 only, as classes of these 256 characters, which are taken from the Unicode pattern's own.

    Letters come first, as no other branch can begin where they do.
    """
    of = lambda kind: "".join(re.escape(c) for c in map(chr, range(256)) if regex.match(kind, c))
    letter, number, space = of(r"\p{L}"), of(r"\p{N}"), of(r"\s")
    return re.compile(f" ?[{letter}]+| ?[{number}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


class SegmentTreeBPE:
    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        kind = spec["pre_tokenizer"]
        if spec.get("normalizer") or kind["type"] != "ByteLevel" or kind["add_prefix_space"] or spec["model"]["type"] != "BPE" or spec["model"].get("ignore_merges"):
            raise ValueError("only plain byte-level BPE files are supported")
        # What would change ids and isn't done here is refused.
        odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback") if spec["model"].get(k)]
        odd += [k for k in ("lstrip", "rstrip", "single_word") for x in spec["added_tokens"] if x.get(k)] + ["use_regex"] * (not kind.get("use_regex", True))
        if odd:
            raise ValueError(f"options of the file that are not supported: {', '.join(sorted(set(odd)))}")
        chars = byte_characters()
        vocab: dict[str, int] = spec["model"]["vocab"]
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.added = added
        self.split = regex.compile("|".join(regex.escape(x) for x in sorted(added, key=len, reverse=True))) if added else None
        self.words = regex.compile(PATTERN)
        size = max([*vocab.values(), *added.values()]) + 1
        self.bytes_of = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(chars[c] for c in token)
        for token, i in added.items():
            self.bytes_of[i] = token.encode()
        self.byte_id = np.zeros(256, np.int32)
        for c, b in chars.items():
            self.byte_id[b] = vocab[c]
        pairs = [x if isinstance(x, list) else x.split(" ") for x in spec["model"]["merges"]]
        self.base = size
        keys = np.array([vocab[a] * size + vocab[b] for a, b in pairs], np.int64)
        into = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.rank = {int(k): r for r, k in reversed(list(enumerate(keys)))}
        self.merged = into
        # Open addressing by a multiplicative hash: pair key to rank.
        bits = max(10, (4 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.slot_key = np.full(1 << bits, -1, np.int64)
        self.slot_rank = np.full(1 << bits, NO_RANK, np.int32)
        todo, at = np.arange(len(keys)), self._slot(keys)
        self.probes = 0
        while len(todo):
            self.probes += 1
            place = at[todo]
            free = self.slot_key[place] < 0
            _, first = np.unique(np.where(free, place, -1), return_index=True)
            first = first[free[first]]
            won = todo[first]
            self.slot_key[at[won]] = keys[won]
            self.slot_rank[at[won]] = won
            done = np.zeros(len(todo), bool)
            done[first] = True
            todo = todo[~done]
            at[todo] = np.where(self.slot_key[at[todo]] == keys[todo], at[todo], (at[todo] + 1) & ((1 << bits) - 1))
            todo = todo[self.slot_key[at[todo]] != keys[todo]]
        self.mask = (1 << bits) - 1
        lengths = np.array([len(b) for b in self.bytes_of], np.int64)
        self.token_length = lengths
        self.token_start = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        self.token_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; ``NO_RANK`` where it can't be merged (or a side is missing, below 0)."""
        keys = left.astype(np.int64) * self.base + right
        keys[(left < 0) | (right < 0)] = -2
        at = self._slot(keys)
        found = self.slot_key[at]
        out = np.where(found == keys, self.slot_rank[at], NO_RANK)
        open_ = np.flatnonzero((found != keys) & (found >= 0) & (keys >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            found = self.slot_key[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.slot_rank[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def merge_many(self, words: list[bytes], width: int) -> list[bytes]:
        """Ids (little-endian uint32 bytes) of words of 2 to ``width`` bytes; ``width`` is a power of two."""
        n = len(words)
        flat = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        length = np.fromiter(map(len, words), np.int64, n)
        column = np.arange(width)
        symbol = np.where(column < length[:, None], self.byte_id[flat], -1).astype(np.int32)
        after = np.where(column + 1 < length[:, None], column + 1, -1).astype(np.int16)
        before = np.broadcast_to(column - 1, (n, width)).astype(np.int16)
        tree = np.full((n, 2 * width), NO_RANK, np.int32)
        tree[:, width : 2 * width - 1] = self.ranks(symbol[:, :-1].ravel(), symbol[:, 1:].ravel()).reshape(n, width - 1)
        level = width
        while level > 1:
            half = level >> 1
            tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level = half
        # From here on by places in the flat arrays: a row's symbols begin at ``first``, its tree at 2 * ``first``.
        trees, symbols, afters, befores = tree.reshape(-1), symbol.reshape(-1), after.reshape(-1), before.reshape(-1)
        first = np.flatnonzero(tree[:, 1] < NO_RANK) * width
        while len(first):
            root = 2 * first
            least = trees.take(root + 1)
            node = np.ones(len(first), np.int64)
            for _ in range(width.bit_length() - 1):
                node <<= 1
                node += trees.take(root + node) != least
            at = node - width
            right = afters.take(first + at).astype(np.int64)
            beyond = afters.take(first + right).astype(np.int64)
            prior = befores.take(first + at).astype(np.int64)
            into = self.merged.take(least)
            symbols[first + at] = into
            symbols[first + right] = -1
            afters[first + at] = beyond
            has, led = beyond >= 0, prior >= 0
            befores[(first + beyond)[has]] = at[has]
            follow = np.where(has, symbols.take(first + beyond), -1)
            ahead = np.where(led, symbols.take(first + prior), -1)
            new = self.ranks(np.concatenate([into, ahead]), np.concatenate([follow, into]))
            trees[root + width + right] = NO_RANK
            trees[root + node] = new[: len(first)]
            trees[(root + width + prior)[led]] = new[len(first) :][led]
            # All three leaves go up side by side; where none is before, the pair's own stands in.
            changed, roots = np.concatenate([node, width + right, np.where(led, width + prior, node)]), np.concatenate([root, root, root])
            for _ in range(width.bit_length() - 1):
                lower = roots + (changed & -2)
                changed >>= 1
                trees[roots + changed] = np.minimum(trees.take(lower), trees.take(lower + 1))
            first = first[trees.take(root + 1) < NO_RANK]
        kept = symbol >= 0
        ids = symbol[kept].astype("<u4").tobytes()
        ends = np.cumsum(kept.sum(axis=1)) * 4
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def merge_one(self, word: bytes) -> bytes:
        """The same for a single word of any length."""
        symbol = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        n = len(symbol)
        none, rank, base, merged = int(NO_RANK), self.rank, self.base, self.merged
        leaves = 1 << max(1, (n - 1).bit_length())
        tree = [none] * (2 * leaves)
        for i in range(n - 1):
            tree[leaves + i] = rank.get(symbol[i] * base + symbol[i + 1], none)
        for i in range(leaves - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]

        def put(place: int, value: int) -> None:
            i = leaves + place
            tree[i] = value
            i >>= 1
            while i:
                least = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == least:
                    break
                tree[i] = least
                i >>= 1

        while (least := tree[1]) < none:
            i = 1
            while i < leaves:
                i *= 2
                if tree[i] != least:
                    i += 1
            i -= leaves
            j = after[i]
            k = after[j]
            symbol[i] = int(merged[least])
            symbol[j] = -1
            after[i] = k
            put(j, none)
            if k >= 0:
                before[k] = i
                put(i, rank.get(symbol[i] * base + symbol[k], none))
            else:
                put(i, none)
            h = before[i]
            if h >= 0:
                put(h, rank.get(symbol[h] * base + symbol[i], none))
        return np.array([s for s in symbol if s >= 0], "<u4").tobytes()

    def recall(self, words: set[str]) -> set[str]:
        """Those of ``words`` that the memory hasn't; what only its older generation has goes over to the younger one, so words that come again and again stay."""
        if self.held > MEMORY_BYTES // 2:
            self.memory, self.older, self.held = {}, self.memory, 0
        new = words.difference(self.memory)
        known = list(self.older.keys() & new)
        self.held += sum(2 * len(w) + WORD_BYTES for w in known)
        self.memory.update(zip(known, map(self.older.__getitem__, known), strict=True))
        return new.difference(known)

    def learn(self, words: Iterable[str]) -> None:
        """Put the ids of new words into the memory, words of similar length together."""
        words = list(words)
        coded = [w.encode() for w in words]
        length = np.fromiter(map(len, coded), np.int64, len(coded))
        self.held += 2 * int(length.sum()) + WORD_BYTES * len(words)
        widths = [4 << k for k in range((WIDE // 4).bit_length())]
        of = np.searchsorted(widths, length)
        for k, width in enumerate([*widths, 0]):
            group = np.flatnonzero(of == k).tolist()
            for start in range(0, len(group), 8192):
                part = group[start : start + 8192]
                some = [coded[i] for i in part]
                self.memory.update(zip((words[i] for i in part), self.merge_many(some, width) if width else map(self.merge_one, some), strict=True))

    def cut(self, text: str) -> list[str]:
        """The words of a text without added tokens."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.words.findall(text)
        return latin_words().findall(text)

    def pieces(self, text: str) -> Iterator[tuple[bool, str]]:
        """Stretches of a text: added special tokens (True) and what lies between."""
        if not self.split or not any(x in text for x in self.added):
            yield False, text
            return
        last = 0
        for m in self.split.finditer(text):
            if m.start() > last:
                yield False, text[last : m.start()]
            yield True, m[0]
            last = m.end()
        if last < len(text):
            yield False, text[last:]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian uint32 bytes."""
        cut, new = [], set()
        for text in texts:
            parts = [(special, [p] if special else self.cut(p)) for special, p in self.pieces(text)]
            cut.append(parts)
            for special, words in parts:
                if not special:
                    new.update(words)
        self.learn(self.recall(new))
        get = self.memory.__getitem__
        return [b"".join(np.uint32(self.added[words[0]]).tobytes() if special else b"".join(map(get, words)) for special, words in parts) for parts in cut]

    def decode(self, ids: bytes) -> str:
        """The text of ids: their bytes in a row, invalid UTF-8 replaced; special tokens stay."""
        i = np.frombuffer(ids, "<u4").astype(np.int64)
        if not len(i):
            return ""
        length = self.token_length[i]
        ends = np.cumsum(length)
        place = np.arange(int(ends[-1])) + np.repeat(self.token_start[i] - (ends - length), length)
        return self.token_bytes[place].tobytes().decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def tokenizer(file: str) -> SegmentTreeBPE:
    return SegmentTreeBPE(file)


def encode_documents(docs: DataFrame, file: str, id_column: str = "doc_id", text_column: str = "text", keep_ids: bool = True) -> DataFrame:
    """Encode every whole text and decode it again.

    Returns the id column, ``n_tokens``, ``ids_sha256`` (of ids as little-endian uint32),
    ``decoded_sha256`` (of the decoded UTF-8) and, with ``keep_ids``, ``ids`` array<int>.
    ``file`` must be readable at the same path on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(file)
        for batch in batches:
            for part in steps(batch, 1):
                coded = bpe.encode(["" if t is None else t for t in part.column(1).to_pylist()])
                out = [
                    part.column(0),
                    pa.array([len(c) // 4 for c in coded], pa.int64()),
                    pa.array([hashlib.sha256(c).hexdigest() for c in coded], pa.string()),
                    pa.array([hashlib.sha256(bpe.decode(c).encode()).hexdigest() for c in coded], pa.string()),
                ]
                names = [id_column, "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    ends = np.cumsum([0, *(len(c) // 4 for c in coded)], dtype=np.int32)
                    out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(coded), "<u4").astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    kind = docs.schema[id_column].dataType.simpleString()
    return batched(docs.select(id_column, text_column)).mapInArrow(run, f"`{id_column}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)


def decode_ids(df: DataFrame, file: str, ids_column: str = "ids", out_column: str = "text") -> DataFrame:
    """``df`` with ``out_column``: the text of each row's id list (null list: null)."""
    from pyspark.sql import functions as F

    @F.pandas_udf("string")
    def text(ids):
        bpe = tokenizer(file)
        return ids.map(lambda x: None if x is None else bpe.decode(np.asarray(x, "<u4").tobytes()))

    return df.withColumn(out_column, text(F.col(ids_column)))
