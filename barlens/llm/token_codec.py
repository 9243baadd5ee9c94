"""Byte-pair encoding and decoding with a minimal acyclic transducer of frequent words."""

from __future__ import annotations

import heapq
import json
import os
import re
import tempfile
from collections.abc import Callable, Iterable, Iterator
from functools import cache, cached_property, lru_cache
from itertools import chain, compress, islice, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F

from barlens.session import stored

#: Words in the lexicon at most.
LEXICON_WORDS = 131_072
#: Counts a task holds before it hands them on, and encodings a task remembers of words that the lexicon lacks.
COUNT_FLUSH, REMEMBERED = 400_000, 100_000
#: Pieces of up to so many bytes are merged together in arrays; longer ones keep a heap each.
SHORT = 64
#: Texts and bytes handled together: bounds what a task holds beside an Arrow batch.
GROUP, GROUP_BYTES = 256, 1 << 20
#: How byte-level vocabularies cut text before merging: a fixed value of the format.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: White space as ``PIECES`` has it, and the words of a text with runs of it.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS = re.compile(rf"\n(?=[^{SPACE}])|[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: Marks the cuts of a text that lacks it.
CUT = "\0"
#: Texts that are not cut at single spaces and line feeds alone, as Arrow reads patterns.
UNEVEN = rf"^[ \n]|[ \n]\z|\x00|[{SPACE}][{SPACE}]"
#: Characters below this one have classes of their own in ``PIECES``, as plain sets, which match faster.
LATIN = 0x180


def latin_pieces() -> str:
    """``PIECES`` for texts of characters below ``LATIN``."""
    sets = ["".join(rf"\x{c:02x}" if c < 256 else chr(c) for c in range(LATIN) if regex.match(rf"\p{{{kind}}}", chr(c))) for kind in ("White_Space", "L", "N")]
    out = PIECES.replace(r"[^\p{White_Space}\p{L}\p{N}]", f"[^{''.join(sets)}]").replace(r"\P{White_Space}", f"[^{sets[0]}]")
    for kind, chars in zip(("White_Space", "L", "N"), sets, strict=True):
        out = out.replace(rf"\p{{{kind}}}", f"[{chars}]")
    return out


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Vocabulary:
    """Merges, ids and added tokens of a byte-level BPE file in the ``tokenizers`` format."""

    def __init__(self, text: str) -> None:
        told = json.loads(text)
        back = {letter: b for b, letter in enumerate(byte_letters())}
        raw = lambda token: bytes(back[c] for c in token)
        ids = told["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in told["model"]["merges"]]
        merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        # Merges as arrays: keys of pairs in order, their ranks, and what each rank makes.
        width = max(ids.values()) + 1
        keys = np.fromiter((a * width + b for a, b in merges), np.int64, len(merges))
        ranks = np.fromiter((rank for rank, _ in merges.values()), np.int64, len(merges))
        order = np.argsort(keys)
        made = np.zeros(len(pairs), np.int32)
        made[ranks] = [new for _, new in merges.values()]
        added = {t["content"]: t["id"] for t in told["added_tokens"]}
        known = {i: raw(t) for t, i in ids.items() if t not in added} | {i: t.encode() for t, i in added.items()}
        known = [known.get(i, b"") for i in range(max(known) + 1)]
        self._set({"width": width, "pair_keys": keys[order], "pair_ranks": ranks[order], "made": made, "added": added,
                   "letters": np.array([ids[letter] for letter in byte_letters()], np.int32),
                   "token_bytes": np.frombuffer(b"".join(known), np.uint8), "token_starts": np.cumsum([0, *map(len, known)])})

    @classmethod
    def of(cls, tables: dict) -> Vocabulary:
        """From ``tables`` of another one; takes no parsing."""
        self = cls.__new__(cls)
        self._set(tables)
        return self

    def _set(self, tables: dict) -> None:
        #: All it holds, in arrays and plain values.
        self.tables = tables
        self.__dict__.update(tables)
        self.none, self.single = len(self.made), self.letters.tolist()
        left, right = np.divmod(np.arange(256 * 256), 256)
        self.letter_ranks = self.rank_of(self.letters[left], self.letters[right])
        self.pieces, self.latin = regex.compile(PIECES), re.compile(latin_pieces())
        self.beyond_latin = re.compile(f"[^\0-{chr(LATIN - 1)}]")
        self.split_added = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None

    @cached_property
    def merges(self) -> dict[tuple[int, int], tuple[int, int]]:
        left, right = np.divmod(self.pair_keys, self.width)
        return dict(zip(zip(left.tolist(), right.tolist(), strict=True), zip(self.pair_ranks.tolist(), self.made[self.pair_ranks].tolist(), strict=True), strict=True))

    def cut(self, words: list[str]) -> tuple[list[str], np.ndarray]:
        """The pieces of all ``words``, one after the other, and how many each has."""
        latin, wide, beyond = self.latin.findall, self.pieces.findall, self.beyond_latin.search
        pieces: list[str] = []
        ends = [0]
        for w in words:
            pieces += latin(w) if w.isascii() or not beyond(w) else wide(w)
            ends.append(len(pieces))
        return pieces, np.diff(ends)

    def merged(self, piece: bytes) -> tuple[int, ...]:
        """Apply the lowest-ranked merge, leftmost first, until none applies."""
        ids = [self.single[b] for b in piece]
        after = list(range(1, len(ids))) + [-1]
        before = list(range(-1, len(ids) - 1))
        found = self.merges.get
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(len(ids) - 1) if (m := found((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if m := found((new, ids[after[i]])):
                    heapq.heappush(heap, (m[0], i, new, ids[after[i]], m[1]))
            if (k := before[i]) >= 0 and (m := found((ids[k], new))):
                heapq.heappush(heap, (m[0], k, ids[k], new, m[1]))
        return tuple(i for i in ids if i >= 0)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not self.none:
            return np.full(len(left), self.none)
        key = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], self.none)

    def merged_all(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``merged`` of many pieces: their ids one after the other, and how many each has.

        Every round applies to each piece its lowest-ranked merge, leftmost first; pieces
        without one leave."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        ids = self.letters[raw]
        own = np.repeat(np.arange(len(pieces)), sizes)
        rank = np.full(len(ids), self.none)
        inside = np.flatnonzero(own[1:] == own[:-1])
        rank[inside] = self.letter_ranks[raw[inside].astype(np.int64) * 256 + raw[inside + 1]]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            low = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(ids)))
            if (low == self.none).any():
                stays = np.repeat(low < self.none, sizes)
                done.append((ids[~stays], own[~stays]))
                ids, own, rank = ids[stays], own[stays], rank[stays]
                sizes, low = sizes[low < self.none], low[low < self.none]
            at = np.flatnonzero(rank == np.repeat(low, sizes))
            at = at[np.append(True, own[at[1:]] != own[at[:-1]])] if len(at) else at
            ids[at] = self.made[rank[at]]
            stays = np.ones(len(ids), bool)
            stays[at + 1] = False
            ids, own, rank = ids[stays], own[stays], rank[stays]
            at -= np.arange(len(at))
            rank[at] = self.none
            left = np.concatenate([at[at + 1 < len(ids)], at[at > 0] - 1])
            left = left[own[left] == own[left + 1]]
            rank[left] = self.rank_of(ids[left], ids[left + 1])
        if not done:
            return np.empty(0, np.int32), np.zeros(len(pieces), np.int64)
        ids, own = (np.concatenate(part) for part in zip(*done, strict=True))
        return ids[np.argsort(own, kind="stable")], np.bincount(own, minlength=len(pieces))


@cache
def vocabulary(text: str) -> Vocabulary:
    return Vocabulary(text)


def words(texts: pa.Array, uneven: str = UNEVEN, cut: Callable[[str], list[str]] = WORDS.findall) -> pa.Array:
    """Lists of the words of each text: cut before white space, and after a line feed alone, each behind another
    character; tokens never cross such a place.  No text has none.

    Where no two white spaces meet, texts are cut before spaces and line feeds only; texts that match ``uneven`` are left to ``cut``."""
    texts = texts.fill_null("")
    marked = pc.replace_substring(pc.replace_substring(texts, " ", CUT + " "), "\n", CUT + "\n" + CUT)
    even = pc.split_pattern(marked, CUT)
    others = pc.or_(pc.match_substring_regex(texts, uneven), pc.equal(pc.binary_length(texts), 0)).to_numpy(zero_copy_only=False)
    if not others.any():
        return even
    own = pa.array(list(map(cut, texts.filter(pa.array(others)).to_pylist())), even.type)
    at = np.where(others, len(even) + np.cumsum(others) - 1, np.arange(len(even)))
    return pa.concat_arrays([even, own]).take(pa.array(at))


class Lexicon:
    """A minimal acyclic transducer over bytes, in flat arrays that can be memory-mapped.

    States share suffixes.  Every arc adds the number of smaller words it passes; the sum
    along a word is its number, which points to its ids."""

    def __init__(self, flat: np.ndarray) -> None:
        n_arcs, n_states, n_words, n_ids = flat[:4]
        cuts = np.cumsum([4, 2 * n_arcs, n_arcs, n_arcs, n_states, n_words + 1, n_ids])
        part = lambda k: flat[cuts[k]:cuts[k + 1]]
        self.keys = part(0).view(np.int64)  # state * 256 + byte, ascending
        self.target, self.adds, self.final, self.starts, self.ids = (part(k) for k in range(1, 6))

    @staticmethod
    def compiled(entries: dict[bytes, tuple[int, ...]]) -> np.ndarray:
        order = sorted(entries)
        # Incremental construction: states behind the last common prefix are final and shared.
        register: dict[tuple, int] = {}
        arcs_of: list[tuple] = []  # per state: ((byte, state), ...)
        counts: list[int] = []
        finals: list[bool] = []

        def shared(arcs: list, final: bool) -> int:
            key = (tuple(arcs), final)
            if key not in register:
                register[key] = len(arcs_of)
                arcs_of.append(key[0])
                finals.append(final)
                counts.append(final + sum(counts[t] for _, t in arcs))
            return register[key]

        path: list[list] = [[[], False]]  # open states: arcs, final
        last = b""
        for w in order:
            common = len(os.path.commonprefix([w, last]))
            while len(path) > common + 1:
                arcs, final = path.pop()
                path[-1][0].append((last[len(path) - 1], shared(arcs, final)))
            path += [[[], False] for _ in range(len(w) - common)]
            path[-1][1] = True
            last = w
        while len(path) > 1:
            arcs, final = path.pop()
            path[-1][0].append((last[len(path) - 1], shared(arcs, final)))
        root = shared(*path[0])
        # The root gets number 0.
        number = {root: 0} | {s: k for k, s in enumerate((s for s in range(len(arcs_of)) if s != root), 1)}
        rows = []
        for s, arcs in enumerate(arcs_of):
            passed = int(finals[s])
            for byte, t in arcs:
                rows.append((number[s] * 256 + byte, number[t], passed))
                passed += counts[t]
        rows.sort()
        table = np.array(rows, np.int64).reshape(-1, 3)
        final = np.zeros(len(arcs_of), np.int32)
        for s, k in number.items():
            final[k] = finals[s]
        starts = np.cumsum([0] + [len(entries[w]) for w in order])
        ids = np.fromiter(chain.from_iterable(entries[w] for w in order), np.int32)
        head = np.array([len(table), len(arcs_of), len(order), len(ids)], np.int32)
        return np.concatenate([head, np.ascontiguousarray(table[:, 0]).view(np.int32), table[:, 1].astype(np.int32), table[:, 2].astype(np.int32),
                               final, starts.astype(np.int32), ids])

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, or -1 where the lexicon lacks it; all words walk together."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat, begins = np.frombuffer(b"".join(words), np.uint8), np.cumsum(lengths) - lengths
        state, number = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        alive = np.arange(len(words)) if len(self.keys) else np.arange(0)
        lost = np.ones(len(words), bool) if not len(self.keys) else np.zeros(len(words), bool)
        step = 0
        while len(alive := alive[lengths[alive] > step]):
            key = state[alive] * 256 + flat[begins[alive] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            lost[alive[~ok]] = True
            alive, at = alive[ok], at[ok]
            number[alive] += self.adds[at]
            state[alive] = self.target[at]
            step += 1
        return np.where(~lost & (self.final[state] == 1), number, -1)

    def find(self, words: list[bytes]) -> list[tuple[int, ...] | None]:
        """Ids of each word, or None where the lexicon lacks it."""
        return [tuple(self.ids[self.starts[n]:self.starts[n + 1]].tolist()) if n >= 0 else None for n in self.numbers(words).tolist()]


@lru_cache(maxsize=1)
def _mapped(name: str) -> Lexicon:
    return Lexicon(np.memmap(SparkFiles.get(name), np.int32, "r"))


def taken(ids: np.ndarray, starts: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``ids[starts[n]:starts[n + 1]]`` of all ``numbers``, one after the other, and their lengths."""
    begins = starts[numbers].astype(np.int64)
    lengths = starts[numbers + 1] - begins
    at = np.arange(lengths.sum()) + np.repeat(begins - (np.cumsum(lengths) - lengths), lengths)
    return ids[at], lengths


class Numbers(dict):
    """Numbers for strings, in the order in which they are first asked for."""

    def __missing__(self, string: str) -> int:
        number = self[string] = len(self)
        return number


class Memory:
    """Encodings by string, in one array of ids."""

    def __init__(self) -> None:
        self.number = Numbers()
        self.ids, self.starts = np.empty(0, np.int32), np.zeros(1, np.int64)

    def numbered(self, strings: Iterable[str]) -> tuple[np.ndarray, list[str]]:
        """The number of each string, and those that are new, in their order; ``add`` must follow with these."""
        before = len(self.number)
        numbers = np.fromiter(map(self.number.__getitem__, strings), np.int64)
        return numbers, list(islice(reversed(self.number), len(self.number) - before))[::-1]

    def add(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.ids = np.concatenate([self.ids, ids])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return taken(self.ids, self.starts, numbers)

    def keep(self, numbers: np.ndarray) -> None:
        """Forget all strings but those of ``numbers`` (ascending)."""
        kept = np.zeros(len(self.number), bool)
        kept[numbers] = True
        self.number = Numbers(zip(compress(self.number, kept.tolist()), range(len(numbers)), strict=True))
        self.ids, lengths = self.of(numbers)
        self.starts = np.append(0, np.cumsum(lengths)).astype(np.int64)


def in_place(parts: list[tuple[list[int] | np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Runs of several parts (places, ids, lengths) in the order of their places, which are 0 to n - 1."""
    places, ids, lengths = (np.concatenate(x) for x in zip(*parts, strict=True))
    starts = np.append(0, np.cumsum(lengths)).astype(np.int64)
    return taken(ids, starts, np.argsort(places))


def sums(lengths: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The sums of the lengths over groups of the given sizes."""
    return np.diff(np.append(0, np.cumsum(lengths))[np.cumsum(sizes)], prepend=0)


class Encoder:
    def __init__(self, vocab: Vocabulary, lexicon: Lexicon) -> None:
        self.vocab, self.lexicon = vocab, lexicon
        self.words, self.pieces = Memory(), Memory()
        #: Numbers of the words in memory that the lexicon has.
        self.known = np.empty(0, np.int64)
        tokens = ["".join(rf"\x{{{ord(c):x}}}" for c in token) for token in vocab.added]
        self.uneven = "|".join([UNEVEN, *tokens])

    def exact(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and lengths of ``words`` by merging alone."""
        cut, sizes = self.vocab.cut(words)
        if len(self.pieces.number) > REMEMBERED:
            self.pieces = Memory()
        numbers, new = self.pieces.numbered(cut)
        raw = [piece.encode() for piece in new]
        short = [k for k, piece in enumerate(raw) if len(piece) <= SHORT]
        long = [k for k, piece in enumerate(raw) if len(piece) > SHORT]
        parts = [(np.array(short, np.int64), *self.vocab.merged_all([raw[k] for k in short]))]
        for k in long:
            ids = np.array(self.vocab.merged(raw[k]), np.int32)
            parts.append((np.array([k]), ids, np.array([len(ids)])))
        self.pieces.add(*in_place(parts))
        ids, lengths = self.pieces.of(numbers)
        return ids, sums(lengths, sizes)

    def _learn(self, new: list[str]) -> None:
        added = [k for k, w in enumerate(new) if w in self.vocab.added]
        numbers = self.lexicon.numbers([w.encode() for w in new])
        numbers[added] = -2
        known, rare = np.flatnonzero(numbers >= 0), np.flatnonzero(numbers == -1)
        self.known = np.concatenate([self.known, known + len(self.words.starts) - 1])
        self.words.add(*in_place([
            (known, *taken(self.lexicon.ids, self.lexicon.starts, numbers[known])), (rare, *self.exact([new[k] for k in rare])),
            (np.array(added, np.int64), np.array([self.vocab.added[new[k]] for k in added], np.int32), np.ones(len(added), np.int64))]))

    def _cut(self, text: str) -> list[str]:
        if self.vocab.split_added is None:
            return WORDS.findall(text)
        # An added token inside a text is a word of its own.
        return [w for part in self.vocab.split_added.split(text) for w in ([part] if part in self.vocab.added else WORDS.findall(part))]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all ``texts``, one after the other, and how many each has."""
        cut = words(texts, self.uneven, self._cut)
        coded = cut.flatten().dictionary_encode()
        if len(self.words.number) - len(self.known) > REMEMBERED:
            self.words.keep(self.known)
            self.known = np.arange(len(self.known))
        numbers, new = self.words.numbered(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        self._learn(new)
        ids, lengths = self.words.of(numbers[coded.indices.to_numpy()])
        return ids, sums(lengths, cut.value_lengths().to_numpy())


def _groups(batches: Iterator[pa.RecordBatch], sized: str) -> Iterator[pa.RecordBatch]:
    """Batches of up to ``GROUP`` rows whose column ``sized`` has about ``GROUP_BYTES`` at most; one at least of every batch."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(sized)).fill_null(0).to_numpy()
        ends = np.append(0, np.cumsum(sizes.astype(np.int64)))
        at = 0
        while at < max(1, len(batch)):
            end = min(at + GROUP, max(at + 1, int(np.searchsorted(ends, ends[at] + GROUP_BYTES, "right")) - 1))
            yield batch.slice(at, end - at)
            at = end
            # What Arrow keeps for later would count beside the executor's heap.
            pa.default_memory_pool().release_unused()


def word_counts(articles: DataFrame) -> DataFrame:
    """(word, n) over all whole titles; tasks count before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.Table] = []
        held = 0

        def summed() -> pa.Table:
            return pa.concat_tables(parts).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])

        for batch in _groups(batches, "title"):
            told = words(batch.column("title")).flatten().value_counts()
            parts.append(pa.table({"word": told.field("values"), "n": told.field("counts")}))
            held += len(told)
            if held > 2 * COUNT_FLUSH:
                parts = [summed()]
                if (held := len(parts[0])) > COUNT_FLUSH:
                    yield from parts[0].to_batches()
                    parts, held = [], 0
        if parts:
            yield from summed().to_batches()

    return articles.select("title").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(articles: DataFrame, limit: int) -> list[str]:
    """The most frequent words, ``limit`` at most.

    Counts fall into levels, sixteen to a doubling; whole levels are taken while they fit,
    so that no more than ``limit`` words ever reach the driver."""
    counts = word_counts(articles).filter("n > 1").withColumn("level", F.floor(16 * F.log2("n")).cast("int"))
    counts = stored(counts, "word-counts")
    fitting = None
    for r in counts.groupBy("level").count().orderBy(F.desc("level")).collect():
        limit -= r["count"]
        if limit < 0:
            break
        fitting = r["level"]
    if fitting is None:
        return []
    return [r["word"] for r in counts.filter(F.col("level") >= fitting).select("word").collect()]


def encode_articles(articles: DataFrame, tokenizer: str, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """``articles`` with ``token_ids``, the ids of every whole ``title``.

    ``tokenizer`` is the path of a byte-level BPE file on the driver; its text goes to the
    tasks.  The corpus' most frequent words (at most ``lexicon_words``) and their ids are
    compiled into a transducer file, which Spark hands to every executor and every task
    memory-maps; words it lacks are merged exactly.  Added tokens inside a text count as
    tokens, nothing is added around it, nothing is cut or padded.

    A null or empty title has no ids; rows without an id, repeated rows and ties are
    encoded like any other; an empty table gives an empty result.  A column named
    ``token_ids`` is replaced, others are passed through.
    """
    with open(tokenizer, encoding="utf-8") as file:
        text = file.read()
    vocab = vocabulary(text)
    exact = Encoder(vocab, Lexicon(Lexicon.compiled({})))
    frequent = [w for w in frequent_words(articles, lexicon_words) if w]
    ids, lengths = exact.exact(frequent)
    ends = np.cumsum(lengths)[:-1] if frequent else []
    table = Lexicon.compiled({w.encode(): tuple(run.tolist()) for w, run in zip(frequent, np.split(ids, ends))})
    sc = articles.sparkSession.sparkContext
    # The driver serves this file to the executors; nothing else reads it.
    handle, path = tempfile.mkstemp(prefix="lexicon-")
    with os.fdopen(handle, "wb") as file:
        file.write(table.tobytes())
    sc.addFile(path)
    name, shared = os.path.basename(path), sc.broadcast(vocab.tables)
    columns = [c for c in articles.columns if c != "token_ids"]
    rows = articles.select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary.of(shared.value), _mapped(name))
        for batch in _groups(batches, "title"):
            ids, lengths = encoder.encode(batch.column("title"))
            made = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*columns, "token_ids"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, token_ids array<int>")


def decoded_texts(lists: pa.ListArray, token_bytes: np.ndarray, token_starts: np.ndarray) -> pa.Array:
    """The text of each list of ids; none or null: empty, an unknown id: nothing."""
    counts = lists.value_lengths().fill_null(0).to_numpy()
    ids = lists.flatten().fill_null(-1).to_numpy()
    ids = np.where((ids >= 0) & (ids < len(token_starts) - 1), ids, -1)
    # The bytes of -1 are those between the last start and the end: none.
    raw, lengths = taken(token_bytes, np.append(token_starts, token_starts[-1]), np.where(ids < 0, len(token_starts) - 1, ids))
    ends = np.append(0, np.cumsum(lengths))[np.append(0, np.cumsum(counts))]
    data = raw.tobytes()
    return pa.array([data[a:b].decode("utf-8", "replace") for a, b in pairwise(ends.tolist())], pa.string())


def decode_articles(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """``encoded`` with ``decoded``, the text of ``token_ids``; bytes that are no UTF-8 become U+FFFD.

    Null or no ids give an empty text; other columns are passed through."""
    with open(tokenizer, encoding="utf-8") as file:
        vocab = vocabulary(file.read())
    shared = encoded.sparkSession.sparkContext.broadcast((vocab.token_bytes, vocab.token_starts))
    columns = [c for c in encoded.columns if c != "decoded"]
    rows = encoded.select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, max(1, len(batch)), GROUP):
                part = batch.slice(at, GROUP)
                pa.default_memory_pool().release_unused()
                yield pa.RecordBatch.from_arrays([*part.columns, decoded_texts(part.column("token_ids"), *shared.value)], [*columns, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, decoded string")
