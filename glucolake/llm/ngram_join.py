"""N-gram Jaccard join: exact set similarity by partitioning the universe of tokens.

A document's set holds the hashes of its distinct 5-word shingles.  Two sets link when
``100 * intersection >= threshold * union``; their sets then differ in at most
H = (|r| + |s|) / 7 tokens (at 75).

*Tokens of one set.*  Tokens are counted first, dealt by hash.  A token that one set alone
has can't be in any intersection, so with u of them s has |s| - u tokens to share: that
bounds the size of its partners, and leaves H - u differences for what is indexed.  A set
without a possible partner goes no further.  What several sets have returns to the sets, with
the power of two its count reaches.  A token that ``HOT`` sets of one flush have is known to
be shared there: it is counted once a flush, and never gathers its sets in one task.

*Pigeonhole.*  The hash range is cut into segments, as many as the size band (a power of two)
asks for, and the shared tokens of a set fall into one subset per segment.  Of any filled
segments of s, at most H - u differ from r.  Call (segment, subset) an element.  Both sets put
their elements into the same order, cheapest to look up first (rarer, then fuller subsets,
then by hash), and index the first H - u + 1: as at most H - u elements of either set are
missing in the other, the two prefixes share one.  A set is indexed in its own band, and in
the band below if a partner can be there.  H grows with the partner: an element that comes
so late that only larger partners could differ in all before it is kept where such a one has
it too.

*One-deletion neighbourhoods.*  In small bands a set may have fewer filled segments than that.
Such a set indexes all its elements and each subset of two tokens or more with one token
left out; a segment then stands for two differences.  Where one set of a pair has elements
enough, its prefix meets one of the other's elements; where neither has, all elements and
neighbourhoods meet.  Allocation is by cost: single subsets first (one key a difference), and
a probe of the band below takes neighbourhoods of the smallest subsets for what is missing
only.  If a set still can't reach its number, everything is done again with twice as many
segments, until all sets can.

*Candidates.*  Sets that share a key meet in pieces dealt by key; those that admit no
partner's size there are left out.  Each is paired with the least id there and the smallest
set of compatible size, not with all others; these pairs are verified exactly on the whole
sets and joined into components.  Then, where a key's sets still lie in different components,
those outside the largest one are tested against those in it that share the key and each
other, block by block, so no link between components is lost, while a group of copies never
becomes all its pairs.  Texts of one template whose other tokens are their own either link or
are left out by their sizes; only sets that share most of a key's tokens, don't link and have
few tokens of their own cost tests of each with each other.

Texts with the same words in a row are one class and indexed once.  Null and empty texts
have an empty set and link with nothing.  Ids are whole numbers (``TypeError`` otherwise);
rows that share an id are one document, whose set is the union of theirs, and each gets its
row; rows with a null id get no component.  An empty table gives an empty result.  Extra
columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from glucolake.llm.components import components
from glucolake.llm.shared import batched, partitions, steps, texts_of, written

WORDS, THRESHOLD = 5, 75
#: Sets below this size index one-deletion neighbourhoods as well.
SMALL = 64
#: Bytes of text for each piece that tokens and keys are dealt to, and pieces a shuffle partition at least.
PIECE_BYTES, PIECES = 128 << 20, 2
#: Tokens that a task gathers before it hands them on: eight a piece where there are many pieces, so that rows don't grow with pieces times input.
FLUSH, MOST_FLUSH = 500_000, 8_000_000
#: Sets of one flush that make a token hot (or, where that is more, what a flush has for a piece), and the level of such tokens.
HOT, HOT_LEVEL = 32, 31
#: Size codes are steps of so many to a power of two: they keep sizes up to some hundreds apart.
CODE_STEPS = 512
#: Bytes of text whose words are hashed at a time.
HASHED = 1 << 18
#: Sets on either side of one test of guests.
BLOCK = 64

U = np.uint64
SPACE = re.compile(rb"[\x20\x09-\x0D]")
_MULTIPLIER = 0x5851F42D4C957F2D


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x + U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier modulo 2^64, and of its inverse."""
    out = []
    for base in (_MULTIPLIER, pow(_MULTIPLIER, -1, 1 << 64)):
        p = np.full(n, base, U)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def word_hashes(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of each word ``[^\\x20\\x09-\\x0D]+`` of a buffer, A-Z lower-cased; long buffers are cut between words."""
    starts, hashes, at = [], [], 0
    while True:
        cut = SPACE.search(buffer, at + HASHED)
        end = cut.start() if cut else len(buffer)
        start, h = _hashed(buffer[at:end])
        starts.append(start + at)
        hashes.append(h)
        at = end
        if not cut:
            return np.concatenate(starts), np.concatenate(hashes)


def _hashed(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    a = np.frombuffer(buffer.lower(), np.uint8)
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, U)
    full = (a != 32) & ((a < 9) | (a > 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[False], full, [False]]).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    n = 1 << max(19, len(a).bit_length())
    power, inverse = _powers(n)
    total = np.concatenate([np.zeros(1, U), np.cumsum((a.astype(U) + U(1)) * power[: len(a)], dtype=U)])
    return start, mix((total[end] - total[start]) * inverse[start] ^ (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def shingle_sets(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text in a row, and the offsets at which texts begin (one more at the end)."""
    start, h = word_hashes(b" ".join(texts))
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    first = np.searchsorted(start, begins)  # of words
    count = np.diff(first)
    n = len(h)
    s = np.zeros(n, U)
    for k in range(min(words, n)):
        s[: n - k] += h[k:] * U(pow(0x9FB21C651E98DF25, k + 1, 1 << 64))
    s = mix(s)
    use = np.zeros(n + 1, np.int64)
    long_ = count >= words
    np.add.at(use, first[:-1][long_], 1)
    np.add.at(use, first[1:][long_] - words + 1, -1)
    use = np.cumsum(use[:-1]) > 0
    for i in np.flatnonzero((count > 0) & ~long_):  # the whole sequence as one
        a, b = first[i], first[i + 1]
        s[a] = mix(np.array([sum(int(x) * pow(0xA24BAED4963EE407, k + 1, 1 << 64) for k, x in enumerate(h[a:b])) + int(b - a) & (1 << 64) - 1], U))[0]
        use[a] = True
    doc = np.repeat(np.arange(len(texts)), count)[use]
    s = s[use]
    ends = np.searchsorted(doc, np.arange(len(texts) + 1))
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a > 1:
            s[a:b].sort()
    if len(s):
        new = np.r_[True, (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])]
        s, doc = s[new], doc[new]
    return s, np.searchsorted(doc, np.arange(len(texts) + 1))


def segments(band: np.ndarray, fine: int) -> np.ndarray:
    """Segments of a band of sizes from 2^band to 2^(band + 1) - 1."""
    top = (2 << band.astype(np.int64)).astype(np.float64)
    return np.where(top <= SMALL, 4 * top, np.where(top <= 256, top, np.where(top <= 512, top / 2, np.floor(top / 2.4)))).astype(np.int64) * fine


def most_apart(r: np.ndarray, s: np.ndarray, threshold: int) -> np.ndarray:
    """The most tokens in which sets of sizes r and s that link can differ: |r| + |s| less twice the least intersection."""
    total = r + s
    return total - 2 * -(-threshold * total // (100 + threshold))


def furthest(r: np.ndarray, largest: np.ndarray, threshold: int) -> np.ndarray:
    """The most tokens in which sets of size r differ from any partner of up to ``largest`` tokens.

    A token more changes ``most_apart`` by 1 up or down, and never down twice in a row: the two largest sizes suffice.
    """
    return np.maximum(most_apart(r, largest, threshold), most_apart(r, largest - 1, threshold))


def keys_of(tokens: np.ndarray, offsets: np.ndarray, threshold: int = THRESHOLD, fine: int = 1, sizes: np.ndarray | None = None, levels: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Index keys of sets, the set of each key, the least partner each key is for (0: any), each set's largest partner, and the sets that couldn't reach their number.

    ``tokens`` are those that other sets have too, sorted by set, ``sizes`` the sizes of the
    whole sets, ``levels`` how common each token is.
    """
    held = np.diff(offsets)
    size = held if sizes is None else sizes
    levels = np.zeros(len(tokens), np.uint8) if levels is None else levels
    band = np.zeros(len(size), np.int64)
    some = held > 0
    band[some] = np.floor(np.log2(size[some])).astype(np.int64)
    single = size - held
    least = -(-threshold * size // 100)  # partner
    limit = np.where(some, np.minimum(100 * size // threshold, (100 + threshold) * held // threshold - size), 0)
    top_below = (1 << band) - 1
    upto_below = np.minimum(limit, top_below)
    keys, sets, lows, short = [], [], [], []
    for scheme, partner, apart in ((band, some & (limit >= np.maximum(least, top_below + 1)), furthest(size, limit, threshold) - single), (band - 1, some & (least <= upto_below) & (top_below > 0), furthest(size, upto_below, threshold) - single)):
        which = np.flatnonzero(partner & (apart >= 0))
        if not len(which):
            continue
        n = held[which]
        place = np.repeat(offsets[which] - np.cumsum(n) + n, n) + np.arange(n.sum())
        token, level, owner = tokens[place], levels[place], np.repeat(np.arange(len(which)), n)
        m = segments(scheme[which], fine)
        seg = ((token >> U(32)) * m.astype(U)[owner]) >> U(32)
        cut = np.flatnonzero(np.r_[True, (seg[1:] != seg[:-1]) | (owner[1:] != owner[:-1])])
        filled = np.diff(np.r_[cut, len(token)])
        of, mixed = owner[cut], mix(token ^ U(0x6A09E667F3BCC909))
        total = np.add.reduceat(mixed, cut)
        base = mix(seg[cut] * U(64) + scheme[which].astype(U)[of])
        e = mix(total + base)
        # A subset is as rare as its rarest token.
        order = np.lexsort((e, -filled, np.minimum.reduceat(level, cut), of))
        have = np.bincount(of, minlength=len(which))
        ends = np.r_[0, np.cumsum(have)]
        nth = np.arange(len(e)) - np.repeat(ends[:-1], have)
        need = apart[which] + 1
        missing = np.maximum(0, need - have)
        small = size[which] < SMALL
        everything = small & (missing > 0) & (scheme is band)
        take = order[(nth < need[of]) | everything[of]]  # sorting keeps each set's elements in its place
        keys.append(e[take])
        sets.append(which[of[take]])
        # Only partners that may differ in as many tokens need a set's later elements.
        from_size = -(-(nth[np.argsort(order)] + single[which][of]) * (100 + threshold) // (100 - threshold)) - size[which][of]
        later = (scheme is band) & ~everything[of] & (from_size > size[which][of])
        lows.append(np.where(later, from_size, 0)[take])
        # Neighbourhoods where elements are missing: all in the own band; below, those of the smallest subsets for what is missing.
        multi = np.bincount(of, filled > 1, len(which)).astype(np.int64)
        short.append(which[(missing > 0) & (~small | (missing > multi))])
        widen = small & (multi > 0) & (missing > 0)
        if widen.any():
            pick = np.flatnonzero(widen[of] & (filled > 1))
            order = pick[np.lexsort((filled[pick], of[pick]))]
            rank = np.arange(len(order)) - np.searchsorted(of[order], of[order])
            order = order[everything[of[order]] | (rank < missing[of[order]])]
            at = np.repeat(cut[order] - np.cumsum(filled[order]) + filled[order], filled[order]) + np.arange(filled[order].sum())
            back = np.repeat(order, filled[order])
            keys.append(mix(total[back] - mixed[at] + base[back]))
            sets.append(which[of[back]])
            lows.append(np.zeros(len(back), np.int64))
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return join(keys, U), join(sets, np.int64), join(lows, np.int64), np.maximum(limit, 0), np.unique(join(short, np.int64))


def code_of(size: np.ndarray) -> np.ndarray:
    return np.floor(CODE_STEPS * np.log2(np.maximum(size, 1))).astype(np.uint16)


def code_reach(threshold: int) -> int:
    return int(np.ceil(CODE_STEPS * np.log2(100 / threshold))) + 1


def piece_of(keys: np.ndarray, pieces: int) -> tuple[np.ndarray, np.ndarray]:
    """The piece a key is dealt to, and its 32 bits there."""
    scrambled = mix(keys)
    return ((scrambled >> U(32)) % U(pieces)).astype(np.int64), scrambled.astype(np.uint32)


def home_of(ids: np.ndarray, pieces: int) -> np.ndarray:
    """The piece at which what concerns a document comes together."""
    return (mix(ids.astype(U)) % U(pieces)).astype(np.int64)


def dealt(to: np.ndarray, pieces: int, *columns: np.ndarray) -> list[list[np.ndarray]]:
    """Each column cut into what goes to each piece, in order."""
    order = np.argsort(to.astype(np.uint16) if pieces <= 1 << 16 else to, kind="stable")
    cut = np.searchsorted(to[order], np.arange(pieces + 1)).tolist()
    return [[x[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)] for x in (c[order] for c in columns)]


def in_steps(ids: np.ndarray) -> bytes:
    """Ids as differences to the one before, which compress well."""
    return np.diff(ids, prepend=0).astype(np.int64).tobytes()


def from_steps(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([np.cumsum(np.frombuffer(b, np.int64)) for b in column.to_pylist()] or [np.zeros(0, np.int64)])


def joined(table: pa.Table, column: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), kind)


def rows_of(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


#: What goes to a piece: its tokens and whose they are, hot tokens; and for documents at home there their hot tokens and sizes.
TOKENS = "piece int, low binary, ids binary, marks binary, hot_ids binary, hot_tokens binary, docs binary, sizes binary"
#: What a piece sends home: tokens that several sets have, their sets and levels.
SHARED = "home int, source int, low binary, ids binary, levels binary, hot_ids binary, hot_tokens binary, docs binary, sizes binary"
#: Keys of sets, their sizes, least and largest partners as codes; documents and sizes pass through.
INDEX = "piece int, keys binary, ids binary, codes binary, lows binary, limits binary, docs binary, sizes binary, short long"
FOUND = "kind int, x long, y long, code int"


def tokens_by_piece(docs: DataFrame, pieces: int, words: int) -> DataFrame:
    """Every token of every set, dealt by token as 4 bytes and its set's id; a hot one once a flush."""
    gathered = max(FLUSH, min(8 * pieces, MOST_FLUSH))
    many = max(HOT, gathered // pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        weight = 0

        def flush() -> pa.RecordBatch:
            ids, size, tokens = (np.concatenate(x) for x in zip(*held, strict=True))
            owner = np.repeat(ids, size)
            to, low = piece_of(tokens, pieces)
            key = to.astype(U) << U(32) | low
            ordered = np.sort(key)
            starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, np.int64)
            hot = ordered[starts][np.diff(np.r_[starts, len(ordered)]) >= many]
            is_hot = hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key if len(hot) else np.zeros(len(key), bool)
            lows, owners = dealt(to[~is_hot], pieces, low[~is_hot], owner[~is_hot])
            (marks,) = dealt((hot >> U(32)).astype(np.int64), pieces, hot.astype(np.uint32))
            hot_ids, hot_tokens = dealt(home_of(owner[is_hot], pieces), pieces, owner[is_hot], key[is_hot])
            docs_, sizes = dealt(home_of(ids, pieces), pieces, ids, size)
            parts = zip(lows, owners, marks, hot_ids, hot_tokens, docs_, sizes, strict=True)
            return rows_of(TOKENS, [(p, a.tobytes(), in_steps(b), c.tobytes(), in_steps(d), e.tobytes(), f.tobytes(), g.astype(np.int64).tobytes()) for p, (a, b, c, d, e, f, g) in enumerate(parts) if len(a) or len(c) or len(d) or len(f)])

        for batch in batches:
            for part in steps(batch, 1):
                tokens, offsets = shingle_sets(texts_of(part.column(1)), words)
                held.append((part.column(0).to_numpy(zero_copy_only=False).astype(np.int64), np.diff(offsets), tokens))
                weight += len(tokens) + part.num_rows
                if weight >= gathered:
                    yield flush()
                    held, weight = [], 0
        if held:
            yield flush()

    return batched(docs).mapInArrow(run, TOKENS)


def shared_tokens(dealt_tokens: DataFrame, pieces: int) -> DataFrame:
    """The tokens of each piece that several sets have, sent to the homes of those sets."""

    def run(table: pa.Table) -> pa.Table:
        piece = table.column("piece")[0].as_py()
        low, ids, marks = joined(table, "low", np.uint32), from_steps(table.column("ids")), np.unique(joined(table, "marks", np.uint32))
        order = np.argsort(low)
        low, ids = low[order], ids[order]
        starts = np.flatnonzero(np.r_[True, low[1:] != low[:-1]]) if len(low) else np.zeros(0, np.int64)
        count = np.diff(np.r_[starts, len(low)])
        marked = np.isin(low[starts], marks)
        level = np.where(marked, HOT_LEVEL, np.minimum(np.floor(np.log2(np.maximum(count, 1))), HOT_LEVEL - 1)).astype(np.uint8)
        use = np.repeat(marked | (count > 1), count)
        low, ids, level = low[use], ids[use], np.repeat(level, count)[use]
        order = np.argsort(ids, kind="stable")
        lows, owners, levels = dealt(home_of(ids[order], pieces), pieces, low[order], ids[order], level[order])
        rows = [(h, piece, a.tobytes(), in_steps(b), c.tobytes(), b"", b"", b"", b"") for h, (a, b, c) in enumerate(zip(lows, owners, levels, strict=True)) if len(a)]
        rows.append((piece, piece, b"", b"", b"", in_steps(from_steps(table.column("hot_ids"))), *(b"".join(table.column(c).to_pylist()) for c in ("hot_tokens", "docs", "sizes"))))
        return pa.Table.from_batches([rows_of(SHARED, rows)])

    return dealt_tokens.groupBy("piece").applyInArrow(run, SHARED)


def index(shared: DataFrame, pieces: int, fine: int, threshold: int) -> DataFrame:
    """Keys of all sets that can have a partner, as rows of many keys for each piece."""

    def run(table: pa.Table) -> pa.Table:
        docs, which = np.unique(joined(table, "docs", np.int64), return_inverse=True)
        sizes = np.bincount(which, joined(table, "sizes", np.int64), len(docs)).astype(np.int64)
        low = table.column("low").to_pylist()
        source = np.repeat(table.column("source").to_numpy(), [len(b) // 4 for b in low])
        token = np.r_[source.astype(U) << U(32) | joined(table, "low", np.uint32), joined(table, "hot_tokens", U)]
        of = np.searchsorted(docs, np.r_[from_steps(table.column("ids")), from_steps(table.column("hot_ids"))])
        level = joined(table, "levels", np.uint8)
        level = np.r_[level, np.full(len(token) - len(level), HOT_LEVEL, np.uint8)]
        token = mix(token)
        order = np.lexsort((token, of))
        token, of, level = token[order], of[order], level[order]
        # Rows that share an id may share tokens; those are counted twice and so always here.
        new = np.r_[True, (token[1:] != token[:-1]) | (of[1:] != of[:-1])] if len(token) else np.zeros(0, bool)
        sizes -= np.bincount(of[~new], minlength=len(docs))
        token, of, level = token[new], of[new], level[new]
        keys, owner, low_size, limit, short = keys_of(token, np.searchsorted(of, np.arange(len(docs) + 1)), threshold, fine, sizes, level)
        to, low_ = piece_of(keys, pieces)
        parts = dealt(to, pieces, low_, docs[owner], code_of(sizes)[owner], code_of(low_size), code_of(limit)[owner])
        rows = [(p, k.tobytes(), in_steps(i), c.tobytes(), o.tobytes(), m.tobytes(), b"", b"", 0) for p, (k, i, c, o, m) in enumerate(zip(*parts, strict=True)) if len(k)]
        rows.append((table.column("home")[0].as_py(), b"", b"", b"", b"", b"", docs.tobytes(), sizes.tobytes(), len(short)))
        return pa.Table.from_batches([rows_of(INDEX, rows)])

    return shared.groupBy("home").applyInArrow(run, INDEX)


def meet(keys_by_piece: DataFrame, threshold: int) -> DataFrame:
    """What each piece finds: 0 pairs (x, y), 1 members y of a key's list x of three or more, 2 documents x of size y, 3 sets that fell short."""
    reach = code_reach(threshold)

    def run(table: pa.Table) -> pa.Table:
        key, docs, sizes = joined(table, "keys", np.uint32).astype(np.int64), joined(table, "docs", np.int64), joined(table, "sizes", np.int64)
        code, least, limit = (joined(table, c, np.uint16).astype(np.int64) for c in ("codes", "lows", "limits"))
        ids = from_steps(table.column("ids"))
        out = [(np.full(len(docs), 2), docs, sizes, np.zeros(len(docs), np.int64))]
        if short := sum(table.column("short").to_pylist()):
            out.append(tuple(np.array([v]) for v in (3, short, 0, 0)))
        order = np.lexsort((least, ids, code, key))
        key, code, least, limit, ids = (x[order] for x in (key, code, least, limit, ids))

        def runs() -> tuple[np.ndarray, np.ndarray]:
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            return starts, np.diff(np.r_[starts, len(key)])

        if len(key):  # a set once in a list, and only where others are
            use = np.r_[True, (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])]
            key, code, least, limit, ids = (x[use] for x in (key, code, least, limit, ids))
            _, count = runs()
            use = np.repeat(count > 1, count)
            key, code, least, limit, ids = (x[use] for x in (key, code, least, limit, ids))
        if len(key):  # a set that can't have one of its size needs a smaller one here that admits its size
            starts, count = runs()
            nth = np.repeat(np.arange(len(starts)), count)
            whole = key << 16 | code
            widest = np.maximum.accumulate(nth << 20 | limit) & (1 << 20) - 1
            last = np.searchsorted(whole, key << 16 | limit, side="right") - 1
            use = (limit >= code) | ((last >= starts[nth]) & (widest[np.maximum(last, 0)] >= code))
            # ... and an element that only larger partners need, one as large as that.
            use &= (least <= code) | (np.searchsorted(whole, key << 16 | least) <= last)
            key, code, least, limit, ids = (x[use] for x in (key, code, least, limit, ids))
        if len(key):
            starts, count = runs()
            whole = key << 16 | code
            first = np.repeat(np.lexsort((ids, key))[starts], count)
            leader = np.searchsorted(whole, key << 16 | np.maximum(code - reach, 0))
            pairs = []
            for other in (first, leader):
                near = (code[other] <= limit) & (code <= limit[other]) & (code[other] >= least) & (code >= least[other]) & (ids != ids[other])
                pairs.append(np.sort(np.stack([ids[near], ids[other][near]], axis=1), axis=1))
            pairs = np.unique(np.concatenate(pairs), axis=0)
            out.append((np.zeros(len(pairs), np.int64), pairs[:, 0], pairs[:, 1], np.zeros(len(pairs), np.int64)))
            many = count > 2
            if many.any():
                name = np.add.reduceat(mix(ids.astype(U)), starts)
                name[~many] = 0
                _, once = np.unique(name, return_index=True)
                keep = np.zeros(len(starts), bool)
                keep[once] = True
                keep = np.repeat(keep & many, count)
                out.append((np.ones(keep.sum(), np.int64), np.repeat(name, count)[keep].view(np.int64), ids[keep], code[keep]))
        kind, x, y, c = (np.concatenate(v) for v in zip(*out, strict=True))
        return pa.table({"kind": pa.array(kind.astype(np.int32)), "x": pa.array(x.astype(np.int64)), "y": pa.array(y.astype(np.int64)), "code": pa.array(c.astype(np.int32))})

    return keys_by_piece.groupBy("piece").applyInArrow(run, FOUND)


def set_table(docs: DataFrame, ids: DataFrame, repeats: DataFrame, words: int) -> DataFrame:
    """``doc`` and its shingle hashes, of documents whose id is in ``ids``; ids of ``repeats`` have the union of their rows' sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, 1):
                tokens, offsets = shingle_sets(texts_of(part.column(1)), words)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(tokens.view(np.int64)))], ["doc", "shingles"])

    needed = written(ids.select(F.col(ids.columns[0]).alias("id")).distinct(), "needed")  # Spark broadcasts it if it is small
    sets = written(batched(docs.join(needed, docs["doc"] == needed["id"], "left_semi")).mapInArrow(run, "doc long, shingles array<bigint>"), "sets")
    if not repeats.limit(1).count():
        return sets
    several = sets.join(repeats, sets["doc"] == repeats["again"], "left_semi").groupBy("doc").agg(F.array_distinct(F.flatten(F.collect_list("shingles"))).alias("shingles"))
    return sets.join(repeats, sets["doc"] == repeats["again"], "left_anti").unionByName(several)


def verified(pairs: DataFrame, docs: DataFrame, repeats: DataFrame, words: int, threshold: int) -> DataFrame:
    """Those of the pairs (a, b) that link, by their whole sets."""
    sets = set_table(docs, pairs.select(F.explode(F.array("a", "b"))), repeats, words)
    first, second = (sets.select(F.col("doc").alias(f"doc_{k}"), F.col("shingles").alias(f"set_{k}")) for k in "ab")
    both = pairs.join(first, F.col("a") == F.col("doc_a")).join(second, F.col("b") == F.col("doc_b"))
    common = F.size(F.array_intersect("set_a", "set_b"))
    return both.where(100 * common >= threshold * (F.size("set_a") + F.size("set_b") - common)).select("a", "b")


def test_blocks(table: pa.Table, threshold: int) -> pa.Table:
    """Links between the sets of side 0 and side 1 (or within side 0, where there is no other) of different parts, one for each set and part."""
    doc, part, side = (table.column(c).to_numpy() for c in ("doc", "part", "side"))
    column = table.column("shingles").combine_chunks()
    offsets = column.offsets.to_numpy().astype(np.int64)
    number = np.unique(column.values.to_numpy()[offsets[0] : offsets[-1]], return_inverse=True)[1]
    offsets -= offsets[0]
    size = np.diff(offsets)
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if (side == 1).any() else left
    held = np.zeros(number.max(initial=-1) + 1, np.int64)
    places = np.concatenate([np.arange(offsets[r], offsets[r + 1]) for r in right])
    starts = np.r_[0, np.cumsum(size[right])[:-1]]
    theirs = number[places]
    a, b = [], []
    for i in left:
        own = number[offsets[i] : offsets[i + 1]]
        held[own] = 1
        common = np.add.reduceat(held[theirs], starts)
        held[own] = 0
        hit = right[(100 * common >= threshold * (size[i] + size[right] - common)) & (part[right] != part[i])]
        _, first = np.unique(part[hit], return_index=True)
        a += [doc[i]] * len(first)
        b += doc[hit[first]].tolist()
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def rest_links(lists: DataFrame, parts: DataFrame, docs: DataFrame, repeats: DataFrame, words: int, threshold: int) -> DataFrame:
    """Links (a, b) between components that share a key, as many as joining them needs.

    A list's anchor is the component that most of its sets are in; the others are its guests.
    Guests are tested against each other and against the sets of the anchor that are in a list
    with guests: in blocks of ``BLOCK`` sets on either side, so what is shuffled is sets by
    block, never pairs.
    """
    of = lists.join(parts, lists["doc"] == parts["node"], "left").select("list", "doc", F.coalesce("root", "doc").alias("part"))
    of = written(of, "lists")
    most = of.groupBy("list", "part").agg(F.count("*").alias("n")).groupBy("list").agg(F.max_by("part", F.struct(F.col("n"), -F.col("part"))).alias("anchor"), F.count("*").alias("parts")).where("parts > 1")
    most = written(most.select(F.col("list").alias("in"), "anchor"), "anchors")
    met = written(of.join(most, of["list"] == most["in"]).select("anchor", "doc", "part").distinct(), "guests")
    guests, own = met.where("part <> anchor"), met.where("part = anchor").select("anchor", "doc")
    anchors = guests.groupBy("anchor").agg(F.count("*").alias("n"))
    size = anchors.join(own.groupBy(F.col("anchor").alias("at")).agg(F.count("*").alias("m")), F.col("anchor") == F.col("at")).select("at", F.ceil(F.col("n") / BLOCK).cast("int").alias("nx"), F.ceil(F.col("m") / BLOCK).cast("int").alias("nm"))
    size = written(size, "blocks")
    block = lambda n: F.pmod(F.xxhash64("doc"), F.col(n)).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    task = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.alias("side"))
    g = guests.join(size, F.col("anchor") == F.col("at")).withColumn("b", block("nx"))
    among = F.transform(upto("nx"), lambda k: task(0, F.least("b", k), F.greatest("b", k), (F.col("b") > k).cast("int")))
    with_own = F.transform(upto("nm"), lambda k: task(1, F.col("b"), k, F.lit(0)))
    g = g.select("anchor", "doc", "part", F.explode(F.concat(among, with_own)).alias("t"))
    o = own.join(size, F.col("anchor") == F.col("at")).withColumn("b", block("nm"))
    o = o.select("anchor", "doc", F.col("anchor").alias("part"), F.explode(F.transform(upto("nx"), lambda k: task(1, k, F.col("b"), F.lit(1)))).alias("t"))
    sets = set_table(docs, met.select("doc"), repeats, words).withColumnRenamed("doc", "of")
    rows = g.unionByName(o).join(sets, F.col("doc") == F.col("of")).select("anchor", "t.kind", "t.i", "t.j", "t.side", "doc", "part", "shingles")
    return rows.groupBy("anchor", "kind", "i", "j").applyInArrow(lambda t: test_blocks(t, threshold), "a long, b long").where("a <> b")


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Copies: ``doc``, ``least``, the least id of those whose texts have the same words in a row; ids of several rows: ``again``, ``n``, which are no copies; and the bytes of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(1))
            digests = [hashlib.blake2b(b" ".join(t.lower().split()), digest_size=16).digest() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array([len(t) for t in texts], pa.int64())], ["doc", "digest", "bytes"])

    rows = written(batched(docs).mapInArrow(run, "doc long, digest binary, bytes long"), "digests")
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    rows = rows.drop("bytes")
    repeats = written(rows.groupBy(F.col("doc").alias("again")).agg(F.count("*").alias("n")).where("n > 1"), "repeats")
    rows = rows.join(repeats, F.col("doc") == F.col("again"), "left_anti")
    groups = written(rows.groupBy("digest").agg(F.min("doc").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n"), "classes")
    return written(rows.join(groups, "digest").where("doc <> least").select("doc", "least"), "copies"), repeats, total


def jaccard_components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """One row per document: id, ``n_shingles``, ``component_id`` (the least id reachable by links)."""
    spark = docs.sparkSession
    kind = docs.schema[id_column].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"ids are whole numbers, {id_column} is {kind.simpleString()}")
    d = docs.select(F.col(id_column).cast("long").alias("doc"), F.col(text_column).alias("text"))
    copies, repeats, total = classes(d.where("doc is not null"))
    single = d.where("doc is not null").join(copies.select(F.col("doc").alias("copy")), F.col("doc") == F.col("copy"), "left_anti")
    pieces, fine = max(PIECES * partitions(spark), -(-total // PIECE_BYTES)), 1
    while True:
        found = written(meet(index(shared_tokens(tokens_by_piece(single, pieces, words), pieces), pieces, fine, threshold), threshold), "found")
        if not found.where("kind = 3").limit(1).count():
            break
        fine *= 2
    pairs = written(found.where("kind = 0").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "pairs")
    links = written(verified(pairs, single, repeats, words, threshold), "links")
    parts = components(links)
    lists = found.where("kind = 1").select(F.col("x").alias("list"), F.col("y").alias("doc")).distinct()
    rest = written(rest_links(lists, parts, single, repeats, words, threshold), "links")
    if rest.limit(1).count():
        parts = components(parts.select(F.col("root").alias("a"), F.col("node").alias("b")).union(rest))
    sizes = found.where("kind = 2").select(F.col("x").alias("own"), F.col("y").alias("n_shingles"))
    base = sizes.join(parts, sizes["own"] == parts["node"], "left").select("own", "n_shingles", F.coalesce("root", "own").alias("component_id"))
    # Copies take over what their class has; empty sets link with nothing.
    same = copies.join(base, copies["least"] == base["own"]).select("doc", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc")).alias("component_id"))
    lost = d.where("doc is null").select("doc", F.lit(None).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    times = base.join(repeats, base["own"] == repeats["again"], "left").withColumn("nth", F.explode(F.sequence(F.lit(1), F.coalesce("n", F.lit(1)).cast("int"))))
    out = times.select(F.col("own").alias("doc"), "n_shingles", "component_id").unionByName(same).unionByName(lost)
    return out.select(F.col("doc").cast(kind).alias(id_column), "n_shingles", F.col("component_id").cast(kind).alias("component_id"))
