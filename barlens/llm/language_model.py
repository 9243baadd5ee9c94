"""Language-model scores of article titles: a hierarchical Pitman-Yor model."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from barlens.llm.common import bucket_count, fold
from barlens.session import stored

#: Rows of every HELD_OUT-th fold are scored, never learned from.
HELD_OUT = 10
#: Contexts of the small in-memory model that tests enumerate; the corpus has one per word.
CONTEXTS = 7
#: Gibbs sweeps, and how many of the first are left out of the average.
SWEEPS, BURN_IN = 4, 1
#: Concentrations of the contexts' restaurants and of the one they share.
CONCENTRATION, SHARED_CONCENTRATION = 5.0, 50.0
#: Customers of one dish seated singly; later ones come in groups of a sixteenth of those seated.
SINGLY = 64
#: Weight that the base gives a token it never saw.
ADDED = 0.1
#: Tokens of a batch of texts, words (as batches list them) of a part of the vocabulary, tokens of a bucket of pairs.
BATCH_TOKENS, PART_WORDS, BUCKET_TOKENS = 4_000_000, 400_000, 3_000_000
#: Words remembered by a task.
WORD_CACHE = 300_000
END = np.uint64(xxhash.xxh3_64_intdigest(b"\n"))  # no word holds a line end

#: What a row between batches of texts, parts of the vocabulary and buckets of pairs holds.
(TEXTS,       # batch: lengths, held out, local tokens, hashes of the local words
 WORDS,       # batch to part: hashes (steps), training tokens
 NUMBERS,     # part to batch: ranks of its words
 COUNTS,      # part: training tokens by rank
 PAIRS,       # batch to bucket: contexts and words (steps), training tokens
 DISHES,      # bucket: pairs learned more than once
 MEMBERS,     # bucket about a batch: training tokens of its pairs, which of the dishes it has
 SINGLES,     # bucket to part: pairs learned once, by word and by context
 TABLES,      # bucket to part: tables of its dishes, by word and by context
 SINGLED,     # part: training tokens, pairs learned once by word and by context
 SHARED,      # part after a sweep: customers and tables of the shared restaurant, tables of the contexts
 SHARES,      # part to bucket: the same, for the words it asked about
 SEATED,      # bucket after a sweep: tables of its dishes
 PREDICTED,   # bucket to batch: training tokens of its pairs, tables over the kept sweeps
 VOCABULARY,  # part to batch: training tokens and the kept sweeps' shared restaurant
 ) = range(15)
MESSAGE = "to bigint, kind int, sender bigint, data binary, sums array<bigint>"


def _mixed(*parts: np.ndarray | int) -> np.ndarray:
    x = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for p in parts:
            x = (x ^ np.asarray(p).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            x = x ^ (x >> np.uint64(32))
    return x


def _uniform(*parts: np.ndarray | int) -> np.ndarray:
    return (_mixed(*parts) >> np.uint64(11)).astype(float) * 2.0**-53


def seated(customers: np.ndarray, weight: np.ndarray, discount: float, *key: np.ndarray | int) -> np.ndarray:
    """Tables that ``customers`` of a dish take, one after the other: the next one opens a
    table with odds ``weight`` against (seated - discount * tables)."""
    done = np.minimum(customers, 1).astype(float)
    tables, step = done.copy(), 0
    active = np.flatnonzero(customers > 1)
    while len(active):
        step += 1
        group = np.minimum(np.where(done[active] < SINGLY, 1, done[active] // 16), customers[active] - done[active])
        odds = weight[active] / (done[active] - discount * tables[active] + weight[active])
        draw = _uniform(*[k[active] if isinstance(k, np.ndarray) else k for k in key], step)
        tables[active] += np.floor(group * odds + draw)
        done[active] += group
        active = active[done[active] < customers[active]]
    return tables


def packed(*arrays: np.ndarray) -> bytes:
    """Whole numbers from 0 on, low bytes first and apart, compressed."""
    head, planes = [len(arrays)], []
    for a in arrays:
        a = np.ascontiguousarray(a if a.dtype == np.uint64 else a.astype(np.int64))
        wide = max(1, -(-int(a.max()).bit_length() // 8)) if len(a) else 1
        head += [len(a), wide]
        planes.append(a.view(np.uint8).reshape(-1, 8)[:, :wide].T.tobytes())
    raw = np.array(head, np.int64).tobytes() + b"".join(planes)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpacked(data: bytes) -> list[np.ndarray]:
    raw = np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd"), np.uint8)
    count = int(raw[:8].view(np.int64)[0])
    head = raw[8:8 + 16 * count].view(np.int64).tolist()
    at, out = 8 + 16 * count, []
    for n, wide in zip(head[::2], head[1::2], strict=True):
        a = np.zeros((n, 8), np.uint8)
        a[:, :wide] = raw[at:at + n * wide].reshape(wide, n).T
        out.append(a.reshape(-1).view(np.int64))
        at += n * wide
    return out


def steps(rising: np.ndarray) -> np.ndarray:
    return np.diff(rising, prepend=rising.dtype.type(0))


def spread(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The part of 0..parts-1 that each hash falls into; parts are ranges of hashes."""
    return (((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def slices(owner: np.ndarray) -> list[tuple[int, slice]]:
    """Runs of equal numbers in a sorted array."""
    begins = np.flatnonzero(np.diff(owner, prepend=-1)).tolist()
    return [(int(owner[i]), slice(i, j)) for i, j in zip(begins, [*begins[1:], len(owner)], strict=False)]


def by_pair(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The order by context and word."""
    if len(word) and max(context.max(), word.max()) < 1 << 31:
        return np.argsort(context << 31 | word)
    return np.lexsort((word, context))


def pair_steps(context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted pairs as steps; words start anew in every context."""
    move = np.diff(context, prepend=-1) != 0
    return steps(context), np.where(move, word, steps(word))


def pairs_again(context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    move, total = context != 0, np.cumsum(word)
    move[:1] = True
    begins = np.flatnonzero(move)
    return np.cumsum(context), total - np.repeat(total[begins] - word[begins], np.diff(np.append(begins, len(word))))


def numbered(articles: DataFrame) -> DataFrame:
    """Batches of bounded size of texts as numbers of their words (kind TEXTS), with the ids of the articles."""
    kind = articles.schema["event_id"].dataType
    rows = articles.select("event_id", "title", F.coalesce(fold("event_id", HELD_OUT) == 0, F.lit(False)).alias("held_out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        held: list[tuple] = []
        total, made = 0, 0
        part = TaskContext.get().partitionId()

        def flush() -> pa.RecordBatch:
            hashes, inverse, counts = np.unique(np.concatenate([h[2] for h in held]), return_inverse=True, return_counts=True)
            order = np.argsort(-counts, kind="stable")
            number = np.empty(len(order), np.int64)
            number[order] = np.arange(len(order))
            data = packed(np.array([len(h[2]) for h in held]), np.array([h[1] for h in held]), number[inverse], hashes[order])
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 24) + made]), pa.array([TEXTS], pa.int32()), pa.array([0]), pa.array([data]), pa.array([[total, len(hashes)]]),
                 pa.array([[h[0] for h in held]], pa.list_(ids))], ["to", "kind", "sender", "data", "sums", "event_ids"])

        for batch in batches:
            ids = batch.schema.field("event_id").type
            for event_id, title, out in zip(*[batch.column(c).to_pylist() for c in ("event_id", "title", "held_out")], strict=True):
                parts = (title or "").encode().lower().split()
                if len(known) > WORD_CACHE:
                    known.clear()
                for w in set(parts).difference(known):
                    known[w] = xxhash.xxh3_64_intdigest(w)
                word = np.empty(len(parts) + 1, np.uint64)
                word[:-1] = np.fromiter(map(known.__getitem__, parts), np.uint64, len(parts))
                word[-1] = END
                held.append((event_id, out, word))
                total += len(word)
                if total >= BATCH_TOKENS:
                    yield flush()
                    held, total, made = [], 0, made + 1
        if held:
            yield flush()

    return rows.mapInArrow(run, f"{MESSAGE}, event_ids array<{kind.simpleString()}>")


def shared_probability(joined, tables, totals: tuple[float, float], kinds: int, discount: float):
    """Of a word in the shared restaurant, whose base is uniform over the words seen and one for all others."""
    return (joined - discount * tables + (SHARED_CONCENTRATION + discount * totals[1]) / (kinds + 1)) / (SHARED_CONCENTRATION + totals[0])


def probability(n: np.ndarray, tables: np.ndarray, all_tables: np.ndarray, customers: np.ndarray, p: np.ndarray, discount: float) -> np.ndarray:
    """Of dishes in their contexts' restaurants, ``p`` being the shared restaurant's."""
    return (n - discount * tables + (CONCENTRATION + discount * all_tables) * p) / (CONCENTRATION + customers)


def reseated(n: np.ndarray, all_tables: np.ndarray, p: np.ndarray, discount: float, word: np.ndarray, context: np.ndarray, sweep: int) -> np.ndarray:
    """Tables of dishes, all their customers seated anew given the last sweep's tables."""
    return seated(n, (CONCENTRATION + discount * all_tables) * p, discount, word, context, sweep)


def reseated_shared(joined: np.ndarray, totals: tuple[float, float], kinds: int, discount: float, word: np.ndarray, sweep: int) -> np.ndarray:
    opened = np.full(len(joined), (SHARED_CONCENTRATION + discount * totals[1]) / (kinds + 1))
    return seated(joined, opened, discount, word, sweep)


class Model:
    """The same model in memory, contexts being numbers: what ``score_titles`` is held against."""

    def __init__(self, tokens: int, kinds: int, customers: np.ndarray, pairs: int, discount: float, shared_discount: float, tables: np.ndarray) -> None:
        self.tokens, self.kinds, self.customers, self.discount, self.shared = tokens, kinds, customers, discount, shared_discount
        # Before the first sweep every dish of a restaurant has one table.
        self.tables = [tables]
        self.totals = [(float(pairs), float(kinds))]

    def sweeps(self, word: np.ndarray, context: np.ndarray, n: np.ndarray, own: np.ndarray, size: int, names: np.ndarray | None = None):
        """For the dishes given (``own``: which word each belongs to; ``names``: of the contexts,
        if not their numbers), per sweep that is known: tables, customers and tables in the
        shared restaurant, and the shared probability before it."""
        tables = np.minimum(n, 1).astype(float)
        first = np.zeros(size, np.int64)
        first[own[::-1]] = np.arange(len(own))[::-1]
        for sweep, (by_context, totals) in enumerate(zip(self.tables, self.totals, strict=True)):
            joined = np.bincount(own, tables, size)
            if sweep == 0:
                parent_tables = np.minimum(joined, 1)
            p = shared_probability(joined, parent_tables, totals, self.kinds, self.shared)
            yield tables, joined, parent_tables, p
            tables = reseated(n, by_context[context], p[own], self.discount, word, context if names is None else names[context], sweep)
            joined = np.bincount(own, tables, size)
            parent_tables = reseated_shared(joined, totals, self.kinds, self.shared, word[first], sweep)
        yield tables, np.bincount(own, tables, size), parent_tables, None

    def predicted(self, context: np.ndarray, n: np.ndarray, own: np.ndarray, sweeps: list) -> np.ndarray:
        """Probability of every dish in its context, averaged over the sweeps after the burn-in."""
        total, kept = np.zeros(len(n)), 0
        for (tables, _, _, p), by_context in list(zip(sweeps, self.tables, strict=False))[BURN_IN + 1:]:
            total += probability(n, tables, by_context[context], self.customers[context], p[own], self.discount)
            kept += 1
        return total / kept


class Mail:
    """The rows that one batch, part or bucket got, in the order of their senders."""

    def __init__(self, rows: pa.Table) -> None:
        self.to = rows["to"][0].as_py()
        self._rows = sorted(zip(*[rows[c].to_pylist() for c in ("kind", "sender", "data")], strict=True), key=lambda r: r[:2])

    def of(self, kind: int) -> Iterator[tuple[int, list[np.ndarray]]]:
        return ((sender, unpacked(data)) for k, sender, data in self._rows if k == kind)

    def one(self, kind: int) -> list[np.ndarray]:
        return next(self.of(kind))[1]

    def joined(self, kind: int) -> list[np.ndarray]:
        return [np.concatenate(c) for c in zip(*[arrays for _, arrays in self.of(kind)], strict=True)]


def _rows(sent: Iterable[tuple], sender: int) -> pa.Table:
    sent = [(to, kind, sender if of is None else of, data, sums) for to, kind, of, data, sums in sent]
    types = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
    return pa.table({c: pa.array([r[k] for r in sent], t) for k, (c, t) in enumerate(zip(("to", "kind", "sender", "data", "sums"), types, strict=True))})


def _answered(groups: int, answer: Callable[[Mail], Iterable[tuple]], *messages: DataFrame) -> DataFrame:
    """What every addressee of the messages sends: (to, kind, of, data, sums), ``of`` being the sender if null."""
    both = messages[0]
    for m in messages[1:]:
        both = both.unionByName(m)

    def run(rows: pa.Table) -> pa.Table:
        mail = Mail(rows)
        return _rows(answer(mail), mail.to)

    return both.repartition(2 * groups, "to").groupBy("to").applyInArrow(run, MESSAGE)


def _kind(messages: DataFrame, *kinds: int) -> DataFrame:
    return messages.filter(F.col("kind").isin(*kinds)).select("to", "kind", "sender", "data", "sums")


def _sums(messages: DataFrame, kind: int, n: int) -> list[int]:
    return [x or 0 for x in messages.filter(F.col("kind") == kind).agg(*[F.sum(F.element_at("sums", k + 1)) for k in range(n)]).first()]


def _local_pairs(lengths: np.ndarray, tokens: np.ndarray, number: np.ndarray, buckets: int) -> tuple[np.ndarray, ...]:
    """Of a batch: the pairs' contexts and words (local), their buckets, and the pair of every token.

    Pairs are in the order of bucket, context number and word number."""
    ends = np.cumsum(lengths)
    before = np.roll(tokens, 1)
    before[ends - lengths] = tokens[ends - 1]
    both, inverse = np.unique(before * len(number) + tokens, return_inverse=True)
    context, word = both // len(number), both % len(number)
    order = by_pair(number[context], number[word])
    bucket = spread(_mixed(number[context], number[word]), buckets)
    order = order[np.argsort(bucket[order], kind="stable")]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return context[order], word[order], bucket[order], place[inverse]


def _numbers(mail: Mail, hashes: np.ndarray, parts: int) -> np.ndarray:
    """Numbers of a batch's words: rank in its part, and the part."""
    number = np.empty(len(hashes), np.int64)
    number[np.argsort(hashes.view(np.uint64))] = np.concatenate([ranks * parts + part for part, (ranks,) in mail.of(NUMBERS)])
    return number


def tell_words(table: DataFrame, parts: int) -> DataFrame:
    """Every batch tells every part of the vocabulary its words there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for to, data in zip(rows["to"].to_pylist(), rows["data"].to_pylist(), strict=True):
                lengths, held, tokens, hashes = unpacked(data)
                n = np.bincount(tokens, np.repeat(held == 0, lengths), len(hashes)).astype(np.int64)
                order = np.argsort(hashes.view(np.uint64))
                hashes, n = hashes.view(np.uint64)[order], n[order]
                sent = [(part, WORDS, None, packed(steps(hashes[at]), n[at]), None) for part, at in slices(spread(hashes, parts))]
                yield from _rows(sent, to).to_batches()

    return table.select("to", "data").mapInArrow(run, MESSAGE)


def number_words(mail: Mail) -> Iterable[tuple]:
    """A part numbers its words, frequent ones first, and tells the batches."""
    told = [(sender, np.cumsum(h.view(np.uint64), dtype=np.uint64), n) for sender, (h, n) in mail.of(WORDS)]
    hashes, inverse = np.unique(np.concatenate([h for _, h, _ in told]), return_inverse=True)
    c = np.bincount(inverse, np.concatenate([n for *_, n in told])).astype(np.int64)
    order = np.argsort(-c, kind="stable")
    rank = np.empty(len(c), np.int64)
    rank[order] = np.arange(len(c))
    yield mail.to, COUNTS, None, packed(c[order]), [int(c.sum()), int((c > 0).sum())]
    begin = 0
    for sender, h, _ in told:
        yield sender, NUMBERS, None, packed(rank[inverse[begin:begin + len(h)]]), None
        begin += len(h)


def tell_pairs(mail: Mail, parts: int, buckets: int) -> Iterable[tuple]:
    """A batch tells the buckets its pairs."""
    lengths, held, tokens, hashes = mail.one(TEXTS)
    number = _numbers(mail, hashes, parts)
    context, word, bucket, own = _local_pairs(lengths, tokens, number, buckets)
    n = np.bincount(own, np.repeat(held == 0, lengths), len(word)).astype(np.int64)
    for to, at in slices(bucket):
        yield to, PAIRS, None, packed(*pair_steps(number[context[at]], number[word[at]]), n[at]), None


def _by_part(kind: int, numbers: np.ndarray, parts: int, *values: np.ndarray) -> Iterable[tuple]:
    """Messages to the parts about words, which are in the order of part and rank."""
    for part, at in slices(numbers % parts):
        yield part, kind, None, packed(steps(numbers[at] // parts), *[v[at] for v in values]), None


def count_pairs(mail: Mail, parts: int) -> Iterable[tuple]:
    """A bucket adds up its pairs.  A pair learned once has one table for good, so that only its word and
    its context are told; pairs learned more often are the dishes of the sweeps."""
    told = [(sender, *pairs_again(c, w), n) for sender, (c, w, n) in mail.of(PAIRS)]
    context, word, n = (np.concatenate([t[k] for t in told]) for k in (1, 2, 3))
    order = by_pair(context, word)
    new = (np.diff(context[order], prepend=-1) != 0) | (np.diff(word[order], prepend=-1) != 0)
    own = np.empty(len(order), np.int64)
    own[order] = np.cumsum(new) - 1
    n, context, word = np.bincount(own, n).astype(np.int64), context[order][new], word[order][new]
    dish = np.cumsum(n > 1) - 1
    begin, size = 0, int((n > 1).sum())
    for sender, c, *_ in told:
        mine = own[begin:begin + len(c)]
        has = np.zeros(size, bool)
        has[dish[mine[n[mine] > 1]]] = True
        yield mail.to, MEMBERS, sender, packed(n[mine], np.packbits(has)), None
        begin += len(c)

    def sides(which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        numbers, at = np.unique(np.concatenate([word[which], context[which]]), return_inverse=True)
        order = np.lexsort((numbers, numbers % parts))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return numbers[order], place[at[:which.sum()]], place[at[which.sum():]]

    numbers, of_word, of_context = sides(n == 1)
    count = lambda x: np.bincount(x, minlength=len(numbers))
    yield from _by_part(SINGLES, numbers, parts, count(of_word), count(of_context))
    numbers, of_word, of_context = sides(n > 1)
    yield from _by_part(TABLES, numbers, parts, count(of_word), count(of_context))
    yield mail.to, DISHES, None, packed(numbers, of_word, of_context, n[n > 1]), [int((n == 1).sum()), int((n == 2).sum())]


def _received(mail: Mail, kind: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    by_word, by_context = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for _, (ranks, words, contexts) in mail.of(kind):
        ranks = np.cumsum(ranks)
        by_word[ranks] += words
        by_context[ranks] += contexts
    return by_word, by_context


def _shares(mail: Mail, sweep: int, joined: np.ndarray, parent: np.ndarray, tables: np.ndarray) -> Iterable[tuple]:
    yield mail.to, SHARED, sweep, packed(joined, parent, tables), [int(x) for x in (joined.sum(), parent.sum(), (joined == 1).sum(), (joined == 2).sum())]
    for sender, (ranks, *_) in mail.of(TABLES):
        ranks = np.cumsum(ranks)
        yield sender, SHARES, None, packed(joined[ranks], parent[ranks], tables[ranks]), None


def open_shared(mail: Mail) -> Iterable[tuple]:
    """Before the first sweep every dish of a restaurant has one table."""
    c, = mail.one(COUNTS)
    once_word, once_context = _received(mail, SINGLES, len(c))
    by_word, by_context = _received(mail, TABLES, len(c))
    yield mail.to, SINGLED, None, packed(c, once_word, once_context), None
    joined = once_word + by_word
    yield from _shares(mail, 0, joined, np.minimum(joined, 1), once_context + by_context)


def seat_shared(mail: Mail, sweep: int, parts: int, totals: tuple[float, float], kinds: int, discount: float) -> Iterable[tuple]:
    c, once_word, once_context = mail.one(SINGLED)
    by_word, by_context = _received(mail, TABLES, len(c))
    joined = once_word + by_word
    parent = reseated_shared(joined, totals, kinds, discount, np.arange(len(c)) * parts + mail.to, sweep).astype(np.int64)
    yield from _shares(mail, sweep + 1, joined, parent, once_context + by_context)


def seat_dishes(mail: Mail, sweep: int, parts: int, totals: tuple[float, float], kinds: int, discount: float, shared_discount: float) -> Iterable[tuple]:
    numbers, of_word, of_context, n = mail.one(DISHES)
    if not len(n):
        yield mail.to, SEATED, sweep, packed(n), None
        return
    joined, parent, tables = mail.joined(SHARES)
    p = shared_probability(joined, parent, totals, kinds, shared_discount)
    t = reseated(n, tables[of_context], p[of_word], discount, numbers[of_word], numbers[of_context], sweep)
    by = lambda x: np.bincount(x, t, len(numbers)).astype(np.int64)
    yield mail.to, SEATED, sweep, packed(t), None
    yield from _by_part(TABLES, numbers, parts, by(of_word), by(of_context))


def tell_predicted(mail: Mail) -> Iterable[tuple]:
    """A bucket tells the batches the customers of their pairs and the tables of the dishes among them."""
    tables = np.sum([t for _, (t,) in mail.of(SEATED)], axis=0)
    for sender, (n, has) in mail.of(MEMBERS):
        mine = np.flatnonzero(np.unpackbits(has.astype(np.uint8), count=len(tables)))
        yield sender, PREDICTED, None, packed(n, tables[mine]), None


def tell_vocabulary(mail: Mail) -> Iterable[tuple]:
    c, *_ = mail.one(SINGLED)
    columns = [c, *[a for _, arrays in mail.of(SHARED) for a in arrays]]
    for sender, (ranks,) in mail.of(NUMBERS):
        yield sender, VOCABULARY, None, packed(*[a[ranks] for a in columns]), None


def score_titles(articles: DataFrame, sweeps: int = SWEEPS, part_words: int = PART_WORDS, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """Log10 probabilities of article titles.

    Input: ``event_id``, ``title`` (the whole text; other columns are ignored).  Output per
    input row: ``event_id``, ``held_out`` (crc32 of the id's text modulo 10 is 0), ``n_tokens``
    (words, A-Z lower-cased, and one end), ``n_known`` (tokens seen in training),
    ``train_tokens``, ``base_score`` (add-0.1 unigram) and ``score``.

    Every context (the word before) is a restaurant whose dishes are the next words; all share
    one parent restaurant over words, whose base is uniform over the words seen in training
    and one for all others.  Gibbs sweeps reseat all customers of a dish given everybody
    else's tables; probabilities are averaged over the sweeps after the burn-in.  Discounts
    come from the counts of counts.  Counts, sweeps and averages cover all training texts.

    Spark moves packed rows between three sorts of groups, each of bounded size: batches of
    texts, parts of the vocabulary (ranges of the words' hashes, about ``part_words``) and
    buckets of pairs (by the pair's hash, about ``bucket_tokens``).  Parts number their words,
    so that sorted pairs are short steps.  A pair learned once never leaves its one table and
    is told to its word and context once; only the others are seated in the sweeps.  A frequent
    word or pair is one entry of each batch or bucket.  Only totals reach the driver.

    A null or empty title is its end alone; a row without an id is learned from and not
    held out; repeated rows and ties count like any other; without training rows every
    token is unknown; an empty table gives an empty result.
    """
    table = stored(numbered(articles), "numbered-titles")
    total, listed = _sums(table, TEXTS, 2)
    parts, buckets, batches = bucket_count(listed, part_words), bucket_count(total, bucket_tokens), bucket_count(total, BATCH_TOKENS // 4)
    words = stored(_answered(parts, number_words, tell_words(table, parts)), "word-numbers")
    tokens, kinds = _sums(words, COUNTS, 2)
    texts = _kind(table, TEXTS)
    told = _answered(batches, lambda mail: tell_pairs(mail, parts, buckets), texts, _kind(words, NUMBERS))
    pairs = stored(_answered(buckets, lambda mail: count_pairs(mail, parts), told), "pair-counts")
    shared = [stored(_answered(parts, open_shared, _kind(words, COUNTS), _kind(pairs, SINGLES, TABLES)), "shared-0")]
    p1, p2 = _sums(pairs, DISHES, 2)
    opened, _, w1, w2 = _sums(shared[0], SHARED, 4)
    between = lambda a, b: min(0.95, max(0.05, a / (a + 2 * b))) if a + b else 0.5
    discount, shared_discount = between(p1, p2), between(w1, w2)
    totals, seats = [(float(opened), float(kinds))], []
    for sweep in range(sweeps):
        now = totals[-1]
        seats.append(stored(_answered(buckets, lambda mail: seat_dishes(mail, sweep, parts, now, kinds, discount, shared_discount),  # noqa: B023
                                      _kind(pairs, DISHES), _kind(shared[-1], SHARES)), f"seated-{sweep}"))
        shared.append(stored(_answered(parts, lambda mail: seat_shared(mail, sweep, parts, now, kinds, shared_discount),  # noqa: B023
                                       _kind(shared[0], SINGLED), _kind(seats[-1], TABLES)), f"shared-{sweep + 1}"))
        totals.append(tuple(map(float, _sums(shared[-1], SHARED, 2))))
    kept = range(BURN_IN + 1, sweeps + 1)
    back = _kind(words, NUMBERS).select(F.col("sender").alias("to"), "kind", F.col("to").alias("sender"), "data", "sums")
    predicted = _answered(buckets, tell_predicted, _kind(pairs, MEMBERS), *[_kind(seats[k - 1], SEATED) for k in kept])
    vocabulary = _answered(parts, tell_vocabulary, _kind(shared[0], SINGLED), back, *[_kind(shared[k], SHARED) for k in kept])
    kind = articles.schema["event_id"].dataType.simpleString()
    bottom = tokens + ADDED * (kinds + 1)

    def score(rows: pa.Table) -> pa.Table:
        mail = Mail(rows)
        lengths, held, local, hashes = mail.one(TEXTS)
        number = _numbers(mail, hashes, parts)
        context, word, _, own = _local_pairs(lengths, local, number, buckets)
        c, *columns = mail.joined(VOCABULARY)
        order = np.argsort(hashes.view(np.uint64))
        c, *columns = (a[np.argsort(order)] for a in (c, *columns))
        told = list(mail.of(PREDICTED))
        n = np.concatenate([a[0] for _, a in told])
        tables = np.where(n == 1, len(kept), 0)
        tables[n > 1] = np.concatenate([a[1] for _, a in told])
        mass = len(kept) * n - discount * tables
        for k, s in enumerate(kept):
            joined, parent, all_tables = columns[3 * k:3 * k + 3]
            p = shared_probability(joined, parent, totals[s], kinds, shared_discount)
            mass += (CONCENTRATION + discount * all_tables[context]) * p[word]
        scores = np.log10(mass / (CONCENTRATION + c[context]) / len(kept))
        begins = np.cumsum(lengths) - lengths
        added = lambda x: np.add.reduceat(x, begins)
        ids = pa.concat_arrays([x for x in rows.filter(pa.compute.equal(rows["kind"], TEXTS))["event_ids"].chunks]).flatten()
        base = np.log10((c + ADDED) / bottom)
        return pa.table({"event_id": ids, "held_out": held > 0, "n_tokens": lengths, "n_known": added((c > 0).astype(np.int64)[local]),
                         "train_tokens": np.full(len(lengths), tokens), "base_score": added(base[local]), "score": added(scores[own])})

    whole = table.select("to", "kind", "sender", "data", "sums", "event_ids")
    for messages in (_kind(words, NUMBERS), predicted, vocabulary):
        whole = whole.unionByName(messages, allowMissingColumns=True)
    return whole.repartition(2 * batches, "to").groupBy("to").applyInArrow(
        score, f"event_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
