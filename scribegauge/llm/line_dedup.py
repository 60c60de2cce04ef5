"""Line deduplication by an exact set-similarity self-join.

A line is the set of its words (ASCII lower-cased, split at ASCII white space).
It is removed when an earlier line, in the order of ``(doc_id, row key, line
number)``, has a Jaccard similarity of at least ``threshold`` with it.  The row
key is 0 but for ids that several rows have; there it is a hash of the text.

1. Rarity.  Words are counted in hashed counters, whose number grows with the
   rows up to a bound, which gives one total order of words: by counter, ties by
   hash.  A collision can only make a word look more frequent; the order stays
   the same for all lines, and so the join stays exact.
2. Classes.  Lines with equal sets collapse into a class, whose first line
   stands for all; copies are collapsed in each task before the shuffle.
3. Join.  Classes are posted under the words of their prefixes (the rarest
   ``n - ceil(t n) + 1``).  Two classes are candidates if they share a word that
   may be their first common one: it leaves enough words behind it in both for
   the overlap asked, and sizes and a parity bitmap of the words allow it.  (The
   bitmaps of two sets differ in at most as many bits as the sets in words.)  A
   word with a counter of one occurs once and is not posted.
4. Scan.  Postings travel in blocks, one bucket of words at a time is scanned
   with arrays, and each line keeps only its first candidate, so a group of
   similar lines gives as many candidates as it has lines.  Buckets that would
   not fit a task go through a row-wise, sorted scan instead, where words with
   long lists are posted in pairs with each other word of the prefix lengthened
   by one, of which similar sets share two; pairs whose lists are still too long
   go to a join.
5. Verification.  The texts of candidate lines are read again from the
   documents, found through a bitmap.  Pairs are compared by a wider parity
   bitmap first, the others as word sets.  A line whose first candidate fails is
   compared with all its candidates in order.
6. Removal.  Later members of a class go, and first lines with an earlier match.

Equal sets are told by 128-bit hashes; similarity is decided on the words themselves.

Defined results: lines of fewer than ``min_words`` words are never judged and
always stay; the registered query and the pipeline judge ``EVERY_LINE`` with a
word; null or empty texts have no lines to judge; rows with a null ``doc_id``
are left alone; rows that share an id and a text count as one document, and a
line removed in it is removed in all its rows; rows that share an id but not the
text are judged each by itself; an empty table gives no rows; extra columns, of
any name, pass through.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import broadcast_if_small, free, saved

THRESHOLD = 0.8
#: Fewest words of a judged line by default, and where every line with a word is judged.
MIN_WORDS, EVERY_LINE = 5, 1
#: Hashed counters: 32 for each row, as a power of two between these bounds.
LEAST_COUNTER_BITS, MOST_COUNTER_BITS = 23, 26
BLOCK = 1 << 16
CODE_BITS, RANK_BITS = 40, 10
LINES_AT_ONCE = 1 << (64 - CODE_BITS - RANK_BITS)
#: Bits of bitmaps of lines: 128 for each row, as a power of two between these bounds.
LEAST_FOUND_BITS, MOST_FOUND_BITS = 25, 30
#: Words a bucket of lines or of postings has on average, and lines a task collects before it sends them.
BUCKET_WORDS, FLUSH_LINES = 1 << 18, 1 << 16
#: Postings of a scanned block from which on the next word begins another: blocks stay far below a megabyte.
BLOCK_POSTINGS = 1 << 12
#: Postings that a task collects before it sends them.
FLUSH_POSTINGS = 1 << 19
#: Postings that a task scans as arrays; a larger bucket is scanned row by row.
MOST_POSTINGS = 1 << 23
#: Lists of postings up to SHORT_RUN are compared within windows of similar size, longer ones as a table by position,
#: in the row-wise scan up to LONG_RUN and beyond by a join.
SHORT_RUN, LONG_RUN = 1 << 11, 1 << 16
#: Rows and columns of such a table at once, and pairs of windows at once.
TABLE, WINDOW = 256, 1 << 18
#: Most words with long lists that are broadcast (a list takes LONG_RUN postings); with more, the join does it all.
MOST_HOT = 1 << 20
#: Measured size up to which the postings of unsettled lines are broadcast, and rounds of trying their next candidate.
SOME_BYTES, ROUNDS = 96 << 20, 2
#: Postings that the row-wise scan compares at once, and rows of an Arrow batch that are Python objects at once.
CHUNK, ROWS_AT_ONCE = 1 << 16, 512

STEP = np.uint64(0x9E3779B97F4A7C15)
IN_WORD = bytes(i not in b" \t\n\v\f\r" for i in range(256))
LOW_BYTES = np.array([(1 << 8 * i) - 1 for i in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
#: Words above this many bytes are hashed one by one.
HUGE_WORD = 1 << 10


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Finalising mixer of 64-bit words."""
    x = x ^ np.uint64(salt)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of ``data`` and the number of the ``\\n``-separated line it is in.

    Words are read eight bytes at a time, all words together.
    """
    low = data.lower()
    inside = np.frombuffer(b"\0" + low.translate(IN_WORD) + b"\0", dtype=np.uint8)
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    raw = np.frombuffer(low + bytes(8), dtype=np.uint8)
    eight = np.ndarray((len(low) + 1,), dtype="<u8", buffer=raw, strides=(1,))
    hashes = mix((eight[starts] & LOW_BYTES[np.minimum(sizes, 8)]) + sizes.astype(np.uint64) * STEP)
    done, longer = 8, np.flatnonzero((sizes > 8) & (sizes <= HUGE_WORD))
    while len(longer):
        left = sizes[longer] - done
        hashes[longer] = mix(hashes[longer] * STEP ^ (eight[starts[longer] + done] & LOW_BYTES[np.minimum(left, 8)]))
        longer, done = longer[left > 8], done + 8
    for i in np.flatnonzero(sizes > HUGE_WORD).tolist():
        word = low[starts[i] : starts[i] + sizes[i]]
        hashes[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    breaks = np.searchsorted(starts, np.flatnonzero(raw[: len(low)] == 10))
    return hashes, np.cumsum(np.bincount(breaks, minlength=len(starts) + 1)[: len(starts)])


def documents_at_once(batch: pa.RecordBatch, min_words: int = MIN_WORDS, size: int = 1 << 19) -> Iterator[tuple[np.ndarray, ...]]:
    """Word hashes of several documents ``id, row key, text`` together, by line.

    Yields ``hashes, line of each word, id, row key and number of each line``;
    lines that are too short are left out.
    """
    kept, held = [], 0
    for doc_id, key, text in _rows(batch):
        if doc_id is None or not text:
            continue
        kept.append((doc_id, key, text))
        held += len(text)
        if held >= size:
            yield _by_line(*zip(*kept), min_words)
            kept, held = [], 0
    if kept:
        yield _by_line(*zip(*kept), min_words)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Rows of a batch, a few of them as Python objects at a time."""
    for start in range(0, batch.num_rows, ROWS_AT_ONCE):
        yield from zip(*(c.to_pylist() for c in batch.slice(start, ROWS_AT_ONCE).columns))


def _by_line(ids: tuple, keys: tuple, texts: tuple, min_words: int) -> tuple[np.ndarray, ...]:
    counts = np.array([t.count(b"\n") + 1 for t in texts])
    hashes, line = hash_words(b"\n".join(texts))
    long_enough = np.bincount(line, minlength=counts.sum()) >= min_words
    keep = long_enough[line]
    owner, key = (np.repeat(np.array(x, dtype=np.int64), counts)[long_enough] for x in (ids, keys))
    number = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    renumber = np.cumsum(long_enough) - 1
    return hashes[keep], renumber[line[keep]], owner, key, number[long_enough]


def unused(docs: DataFrame, stem: str) -> str:
    """A column name that ``docs`` doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while stem in taken:
        stem += "_"
    return stem


def repeated_ids(docs: DataFrame) -> DataFrame | None:
    """The ids that several rows have, or None."""
    repeated = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    repeated = saved(repeated.select("doc_id"))
    return None if repeated.isEmpty() else repeated


def with_row_key(docs: DataFrame, name: str, repeated: DataFrame | None) -> DataFrame:
    """``docs`` with a long column that tells rows with one id and different texts apart; 0 where no other row has the id."""
    if repeated is None:
        return docs.withColumn(name, F.lit(0).cast("long"))
    again = unused(docs, "_ld_again")
    marked = docs.join(broadcast_if_small(repeated.select("doc_id", F.lit(True).alias(again))), "doc_id", "left")
    key = F.when(F.col(again), F.xxhash64("text")).otherwise(0)
    return marked.select(*(F.col(f"`{c}`") for c in docs.columns), key.alias(name))


def _raw(keyed: DataFrame) -> DataFrame:
    """Id, row key and bytes of the texts; ``keyed`` has the columns ``doc_id, row_key, text``."""
    return keyed.select("doc_id", "row_key", F.col("text").cast("binary").alias("text"))


def bits_for(rows: int, each: int, least: int, most: int) -> int:
    """Bits that number ``each`` cells for a row, within bounds."""
    return min(most, max(least, math.ceil(math.log2(max(rows, 1) * each))))


def rank_words(keyed: DataFrame, min_words: int, bits: int) -> tuple[np.ndarray, int]:
    """Rarity by hashed counter, over all words of lines long enough to be judged, and the number of those words.

    A rank is the counter up to 64, then a class of its logarithm.  Tasks send
    their counters as sparse blocks; a block is summed while its parts stream by.
    """
    schema = "part int, at binary, counts binary"
    names = ["part", "at", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, dtype=np.uint32)
        for batch in batches:
            for hashes, *_ in documents_at_once(batch, min_words):
                np.add.at(total, hashes >> np.uint64(64 - bits), np.uint32(1))
        rows = []
        for i in range(0, len(total), BLOCK):
            at = np.flatnonzero(total[i : i + BLOCK])
            if len(at):
                rows.append((i // BLOCK, at.astype(np.uint16).tobytes(), total[i : i + BLOCK][at].tobytes()))
        for i in range(0, len(rows), 64):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 64]), (pa.int32(), pa.binary(), pa.binary()))], names=names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != part:
                    if part is not None:
                        yield ranked(part, total)
                    part, total = row["part"], np.zeros(BLOCK, dtype=np.int64)
                total[np.frombuffer(row["at"], np.uint16)] += np.frombuffer(row["counts"], np.uint32)
        if part is not None:
            yield ranked(part, total)

    def ranked(part: int, total: np.ndarray) -> pa.RecordBatch:
        many = np.maximum(total, 64)
        rank = np.where(total <= 64, total, np.minimum(64 + np.log2(many / 64) * 25, (1 << RANK_BITS) - 1))
        columns = [pa.array([part], pa.int32()), pa.array([rank.astype(np.uint16).tobytes()]), pa.array([int(total.sum())], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["part", "ranks", "words"])

    sent = _raw(keyed).mapInArrow(run, schema).repartition("part").sortWithinPartitions("part")
    ranks, words = np.zeros(1 << bits, np.uint16), 0
    for row in sent.mapInArrow(add, "part int, ranks binary, words long").collect():
        ranks[row["part"] * BLOCK : (row["part"] + 1) * BLOCK] = np.frombuffer(row["ranks"], np.uint16)
        words += row["words"]
    return ranks, words


def prefix_length(n: int | np.ndarray, threshold: float = THRESHOLD):
    """Words of a set of ``n`` of which any similar set must have one."""
    return n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1


def asked_overlap(both: np.ndarray, threshold: float) -> np.ndarray:
    """Common words that similarity asks of sets with ``both`` words in all."""
    return np.ceil(threshold / (1 + threshold) * both - 1e-9)


def may_match(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], threshold: float) -> np.ndarray:
    """Size, position and bitmap filters for sets whose first common word is the given one; ``a`` and ``b`` are ``n, place, bits``."""
    (n1, p1, b1), (n2, p2, b2) = a, b
    asked = asked_overlap(n1 + n2, threshold)
    sized = np.minimum(n1, n2) >= threshold * np.maximum(n1, n2) - 1e-9
    placed = np.minimum(n1 - p1, n2 - p2) >= asked
    return sized & placed & (n1 + n2 - np.bitwise_count(b1 ^ b2) >= 2 * asked)


#: Columns of packed records: the place of a line, a class, and a posting.
PLACE = [("doc", "<i8"), ("key", "<i8"), ("line", "<i4")]
MEMBER = [("k1", "<u8"), ("k2", "<u8"), *PLACE]
CLASS = [*MEMBER, ("n", "<i4"), ("bits", "<u8"), ("copies", "<i4"), ("posts", "<i4")]
WORD = [("word", "<u4"), ("at", "<i4")]
POSTING = [("word", "<u4"), *PLACE, ("n", "<i4"), ("at", "<i4"), ("bits", "<u8")]


def pack(columns: dict[str, np.ndarray], layout: list[tuple[str, str]]) -> bytes:
    """Columns as bytes, each byte of the values in a row of its own: zeros and repeats then compress well."""
    parts = []
    for name, kind in layout:
        values = np.ascontiguousarray(columns[name], dtype=kind)
        parts.append(values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes())
    return b"".join(parts)


def unpack(data: bytes, layout: list[tuple[str, str]]) -> dict[str, np.ndarray]:
    width = sum(int(kind[-1]) for _, kind in layout)
    size, start, columns = len(data) // width, 0, {}
    for name, kind in layout:
        wide = int(kind[-1])
        planes = np.frombuffer(data, np.uint8, size * wide, start).reshape(wide, size)
        columns[name] = np.ascontiguousarray(planes.T).view(kind).reshape(size)
        start += size * wide
    return columns


def unpack_all(blobs: list[bytes], layout: list[tuple[str, str]]) -> dict[str, np.ndarray]:
    parts = [unpack(b, layout) for b in blobs]
    return {name: np.concatenate([p[name] for p in parts]) for name, _ in layout}


def taken(columns: dict[str, np.ndarray], rows: np.ndarray) -> dict[str, np.ndarray]:
    return {name: values[rows] for name, values in columns.items()}


def spans(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers from ``first`` on, ``sizes`` each, one span after the other."""
    return np.arange(sizes.sum()) + np.repeat(first - np.cumsum(sizes) + sizes, sizes)


def describe_lines(keyed: DataFrame, ranks: np.ndarray, buckets: int, threshold: float, min_words: int) -> DataFrame:
    """``bucket, members, classes, words``: all judged lines in blocks, by bucket of their class.

    ``members`` has the class key and place of every line, ``classes`` the first
    line of each class in the block with its size, parity bitmap, copies and
    number of words in ``words``: 32-bit codes and places, in the order of
    rarity, of the words of the prefix and of the word after it that occur more
    than once.  Sets too small to be similar to another than an equal one have none.
    """
    shared = keyed.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, held, lines = shared.value, [], 0
        for batch in batches:
            for hashes, line, *place in documents_at_once(batch, min_words):
                for start in range(0, len(place[0]), LINES_AT_ONCE):
                    a, b = np.searchsorted(line, [start, start + LINES_AT_ONCE])
                    part = [x[start : start + LINES_AT_ONCE] for x in place]
                    held.append(_describe(hashes[a:b], line[a:b] - start, part, ranks, threshold))
                    lines += len(part[0])
                if lines >= FLUSH_LINES:
                    yield from _blocks(held, buckets)
                    held, lines = [], 0
        if held:
            yield from _blocks(held, buckets)

    return _raw(keyed).mapInArrow(run, "bucket int, members binary, classes binary, words binary")


def _describe(hashes, line, place, ranks, threshold) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    code_bits = np.uint64(CODE_BITS)
    rank = ranks[hashes >> np.uint64(64 - (len(ranks) - 1).bit_length())].astype(np.uint64)
    key = line.astype(np.uint64) << np.uint64(CODE_BITS + RANK_BITS) | rank << code_bits | hashes >> np.uint64(64 - CODE_BITS)
    order = np.argsort(key)
    key, hashes = key[order], hashes[order]
    new = np.append(True, key[1:] != key[:-1])
    key, hashes = key[new], hashes[new]
    line = (key >> np.uint64(CODE_BITS + RANK_BITS)).astype(np.int64)
    n = np.bincount(line, minlength=len(place[0]))
    first = np.cumsum(n) - n
    at = np.arange(len(key)) - first[line]
    posted = (at <= prefix_length(n, threshold)[line]) & ((key >> code_bits) & np.uint64((1 << RANK_BITS) - 1) != 1)
    posted &= (n >= threshold * (n + 1) - 1e-9)[line]
    lines = {"k1": np.add.reduceat(mix(hashes, 1), first), "k2": np.add.reduceat(mix(hashes, 2), first)}
    lines |= dict(zip(("doc", "key", "line"), place)) | {"n": n, "bits": np.bitwise_xor.reduceat(np.uint64(1) << (hashes & np.uint64(63)), first)}
    lines["posts"] = np.bincount(line[posted], minlength=len(n))
    return lines, {"word": (hashes[posted] >> np.uint64(32)).astype(np.uint32), "at": at[posted]}


def _first_of_class(lines: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An order by class and place, and which lines in it begin a class."""
    order = np.lexsort([lines[x] for x in ("line", "key", "doc", "k2", "k1")])
    k1, k2 = lines["k1"][order], lines["k2"][order]
    return order, np.append(True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]))


def _blocks(held: list, buckets: int) -> Iterator[pa.RecordBatch]:
    lines, words = ({k: np.concatenate([part[i][k] for part in held]) for k in held[0][i]} for i in (0, 1))
    start = np.cumsum(lines["posts"]) - lines["posts"]
    order, new = _first_of_class(lines)
    bucket = lines["k1"][order] % np.uint64(buckets)
    by_bucket = np.argsort(bucket, kind="stable")
    order, new, bucket = order[by_bucket], new[by_bucket], bucket[by_bucket]
    firsts = np.flatnonzero(new)
    chosen = order[firsts]
    classes = taken(lines, chosen) | {"copies": np.diff(np.append(firsts, len(order)))}
    words = taken(words, spans(start[chosen], lines["posts"][chosen]))
    lines = taken(lines, order)
    of_class, post_end = bucket[firsts], np.append(0, np.cumsum(classes["posts"]))
    rows = []
    for b in np.unique(bucket):
        (i, j), (k, m) = (np.searchsorted(x, [b, b + 1]) for x in (bucket, of_class))
        inner = slice(post_end[k], post_end[m])
        rows.append(
            (int(b), pack({x: lines[x][i:j] for x, _ in MEMBER}, MEMBER), pack({x: classes[x][k:m] for x, _ in CLASS}, CLASS), pack({x: words[x][inner] for x, _ in WORD}, WORD))
        )
    for i in range(0, len(rows), 64):
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 64]), kinds)], names=["bucket", "members", "classes", "words"])


def _collapsed(rows: list[dict]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray], np.ndarray]:
    """The classes of one bucket, with the places of their words in ``words``."""
    classes, words = unpack_all([r["classes"] for r in rows], CLASS), unpack_all([r["words"] for r in rows], WORD)
    start = np.cumsum(classes["posts"]) - classes["posts"].astype(np.int64)
    order, new = _first_of_class(classes)
    firsts = np.flatnonzero(new)
    copies = np.add.reduceat(classes["copies"][order].astype(np.int64), firsts)
    chosen = order[firsts]
    return taken(classes, chosen) | {"copies": copies}, words, start[chosen]


def _buckets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of one bucket at a time, of batches in the order of buckets."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row["bucket"] != held[0]["bucket"]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _by_bucket(df: DataFrame) -> DataFrame:
    return df.repartition("bucket").sortWithinPartitions("bucket")


def post_classes(lines: DataFrame, buckets: int, threshold: float) -> DataFrame:
    """``bucket, n, block``: postings of all classes by bucket of their word, and under negative numbers the classes of several lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for rows in _buckets_of(batches):
            classes, words, start = _collapsed(rows)
            many = taken(classes, np.flatnonzero(classes["copies"] > 1))
            if len(many["k1"]):
                yield block_rows([(-1 - rows[0]["bucket"], len(many["k1"]), pack(many, MEMBER))])
            times = classes["posts"].astype(np.int64)
            own, at = np.repeat(np.arange(len(times)), times), spans(start, times)
            core = words["at"][at] < prefix_length(classes["n"].astype(np.int64), threshold)[own]
            posts = taken({x: classes[x] for x in ("doc", "key", "line", "n", "bits")}, own[core]) | taken(words, at[core])
            held.append(posts)
            size += len(posts["word"])
            if size >= FLUSH_POSTINGS:
                yield from sent(held)
                held, size = [], 0
        if held:
            yield from sent(held)

    def sent(held: list[dict]) -> Iterator[pa.RecordBatch]:
        posts = {x: np.concatenate([h[x] for h in held]) for x, _ in POSTING}
        bucket = posts["word"] % np.uint32(buckets)
        order = np.lexsort((posts["word"], bucket))
        bucket, posts = bucket[order], taken(posts, order)
        ends = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))[: len(bucket)], len(bucket))
        rows = [(int(bucket[i]), int(j - i), pack({x: posts[x][i:j] for x, _ in POSTING}, POSTING)) for i, j in zip(ends[:-1], ends[1:])]
        for i in range(0, len(rows), 64):
            yield block_rows(rows[i : i + 64])

    def block_rows(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary()))], names=["bucket", "n", "block"])

    return _by_bucket(lines.select("bucket", "classes", "words")).mapInArrow(run, "bucket int, n long, block binary")


def first_of_lists(
    word: np.ndarray, rank: np.ndarray, n: np.ndarray, at: np.ndarray, bits: np.ndarray, threshold: float
) -> tuple[np.ndarray, np.ndarray]:
    """For each posting of a list the first one that may match it, as two arrays of row numbers; postings come by word and place."""
    starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    found_b, found_a = [], []
    for start, length in zip(starts.tolist(), np.diff(np.append(starts, len(word))).tolist()):
        for low in range(0, length, TABLE):
            rows = np.arange(start + low, start + min(length, low + TABLE))
            # Columns go from the first line on; a row leaves at its first hit, which comes early in groups of copies.
            for left in range(0, low + TABLE, TABLE):
                cols = np.arange(start + left, start + min(length, left + TABLE))
                ok = _table(rows, cols, rank, n, at, bits, threshold)
                hit = ok.any(axis=1)
                found_b.append(rows[hit])
                found_a.append(cols[ok[hit].argmax(axis=1)])
                rows = rows[~hit]
                if not len(rows):
                    break
    return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in (found_b, found_a))


def _table(rows, cols, rank, n, at, bits, threshold) -> np.ndarray:
    """Which of ``cols`` are earlier than ``rows`` and may match them."""
    return may_match(
        (n[cols][None, :], at[cols][None, :], bits[cols][None, :]),
        (n[rows][:, None], at[rows][:, None], bits[rows][:, None]), threshold,
    ) & (rank[cols][None, :] < rank[rows][:, None])


def all_of_lists(word, rank, n, at, bits, threshold, wanted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All earlier postings of the same list that may match those in ``wanted``, as pairs of row numbers."""
    starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    for start, length in zip(starts.tolist(), np.diff(np.append(starts, len(word))).tolist()):
        chosen = start + np.flatnonzero(wanted[start : start + length])
        for low in range(0, len(chosen), TABLE):
            rows = chosen[low : low + TABLE]
            for left in range(start, rows[-1] + 1, TABLE):
                cols = np.arange(left, min(left + TABLE, rows[-1] + 1))
                b, a = np.nonzero(_table(rows, cols, rank, n, at, bits, threshold))
                yield rows[b], cols[a]


def windows(key, rank, n, at, bits, rows, threshold) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of postings that may match, ``(later, earlier)``, with the larger set in ``rows``; ``key`` is word and size, in order."""
    word = key[rows] >> np.uint64(32) << np.uint64(32)
    # The largest set that a posting may match through this word, as the first common one.
    reach = np.floor((n - at + 1e-6) * (1 + threshold) / threshold - n).astype(np.int64)
    low = np.searchsorted(key, word | np.ceil(threshold * n[rows] - 1e-9).astype(np.uint64))
    high = np.minimum(rows, np.searchsorted(key, word | np.maximum(reach[rows], 0).astype(np.uint64), side="right"))
    count = np.maximum(high - low, 0)
    some = count > 0
    rows, low, count = rows[some], low[some], count[some]
    ends = np.cumsum(count)
    start = 0
    while start < len(rows):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + WINDOW, side="right")))
        i, j = np.repeat(rows[start:stop], count[start:stop]), spans(low[start:stop], count[start:stop])
        start = stop
        near = n[i] <= reach[j]
        i, j = i[near], j[near]
        ok = may_match((n[i], at[i], bits[i]), (n[j], at[j], bits[j]), threshold) & (rank[i] != rank[j])
        i, j = i[ok], j[ok]
        yield np.where(rank[i] > rank[j], i, j), np.where(rank[i] > rank[j], j, i)


class Bucket:
    """The postings of one bucket in order of word and size, with a number for each class in order of place."""

    def __init__(self, posts: dict[str, np.ndarray]):
        order = np.argsort(posts["word"].astype(np.uint64) << np.uint64(32) | posts["n"].astype(np.uint64), kind="stable")
        self.posts = posts = taken(posts, order)
        self.key = posts["word"].astype(np.uint64) << np.uint64(32) | posts["n"].astype(np.uint64)
        by_place = np.lexsort((posts["line"], posts["key"], posts["doc"]))
        new = np.zeros(len(by_place), dtype=bool)
        for x in ("doc", "key", "line"):
            new[1:] |= posts[x][by_place][1:] != posts[x][by_place][:-1]
        self.rank = np.empty(len(by_place), dtype=np.int64)
        self.rank[by_place] = np.cumsum(new)
        self.of_rank = by_place[np.append(True, new[1:])] if len(by_place) else by_place
        starts = np.flatnonzero(np.append(True, posts["word"][1:] != posts["word"][:-1]))[: len(by_place)]
        run = np.diff(np.append(starts, len(by_place)))
        self.run = np.repeat(run, run)

    def pieces(self) -> Iterator[slice]:
        """The postings in stretches of whole lists, of ``BLOCK_POSTINGS`` or a little more each."""
        word, start = self.posts["word"], 0
        while start < len(word):
            last = min(start + BLOCK_POSTINGS, len(word)) - 1
            stop = int(np.searchsorted(word, word[last], side="right"))
            yield slice(start, stop)
            start = stop

    def arrays(self, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        p = self.posts
        return p["word"][rows], self.rank[rows], p["n"][rows].astype(np.int64), p["at"][rows].astype(np.int64), p["bits"][rows]

    def pairs(self, threshold: float, short_run: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Class numbers ``(later, earlier)`` of candidates in the lists up to ``short_run``."""
        _, rank, n, at, bits = self.arrays(np.arange(len(self.rank)))
        for b, a in windows(self.key, rank, n, at, bits, np.flatnonzero((self.run <= short_run) & (self.run > 1)), threshold):
            yield rank[b], rank[a]

    def long_lists(self, short_run: int) -> np.ndarray:
        """Row numbers of the postings in longer lists, by word and place."""
        rows = np.flatnonzero(self.run > short_run)
        return rows[np.lexsort((self.rank[rows], self.posts["word"][rows]))]

    def first_candidates(self, threshold: float, short_run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each class with its first candidate, as numbers, and all classes in short lists that are part of a pair."""
        best = np.full(len(self.of_rank), len(self.rank), dtype=np.int64)
        part = np.zeros(len(self.of_rank), dtype=bool)
        for b, a in self.pairs(threshold, short_run):
            np.minimum.at(best, b, a)
            part[b] = part[a] = True
        rows = self.long_lists(short_run)
        if len(rows):
            arrays = self.arrays(rows)
            b, a = (arrays[1][x] for x in first_of_lists(*arrays, threshold))
            np.minimum.at(best, b, a)
        b = np.flatnonzero(best < len(self.rank))
        return b, best[b], np.flatnonzero(part)

    def candidates_of(self, wanted: np.ndarray, threshold: float, short_run: int) -> np.ndarray:
        """All candidates of the classes in ``wanted``, as two rows of class numbers without repeats."""
        size = len(self.of_rank)
        found = [np.unique(b[wanted[b]] * size + a[wanted[b]]) for b, a in self.pairs(threshold, short_run)]
        rows = self.long_lists(short_run)
        if len(rows):
            arrays = self.arrays(rows)
            rank = arrays[1]
            found += [rank[b] * size + rank[a] for b, a in all_of_lists(*arrays, threshold, wanted[rank])]
        return np.array(divmod(np.unique(np.concatenate([*found, np.empty(0, np.int64)])), size)) if size else np.empty((2, 0), np.int64)

    def place(self, classes: np.ndarray) -> list[np.ndarray]:
        return [self.posts[x][self.of_rank[classes]] for x in ("doc", "key", "line")]


#: Kinds of rows of the scan: a block of scanned postings, a candidate, a block of postings left out, classes of several lines.
SCANNED, CANDIDATE, LEFT_OUT, COPIES = range(4)
PAIR_FIELDS = "b_doc long, b_key long, b_line int, a_doc long, a_key long, a_line int"
PAIR_TYPES = [pa.int64(), pa.int64(), pa.int32()] * 2
SCAN = pa.schema([("kind", pa.int32()), ("block", pa.binary()), *zip([x.split()[0] for x in PAIR_FIELDS.split(", ")], PAIR_TYPES)])
B, A = ["b_doc", "b_key", "b_line"], ["a_doc", "a_key", "a_line"]


def _scan_rows(kind: int, size: int, blocks: list[bytes] | None = None, b: list | None = None, a: list | None = None) -> pa.RecordBatch:
    places = [pa.nulls(size, t) if x is None else pa.array(x, t) for x, t in zip([*(b or [None] * 3), *(a or [None] * 3)], PAIR_TYPES)]
    return pa.RecordBatch.from_arrays([pa.array([kind] * size, pa.int32()), pa.array(blocks or [None] * size, pa.binary()), *places], schema=SCAN)


def scan_blocks(posted: DataFrame, threshold: float, short_run: int, long_run: int, most: int = MOST_POSTINGS) -> DataFrame:
    """Each bucket of postings scanned for first candidates; rows as told by ``kind``.

    A candidate without ``a`` names a line that is part of some pair.  Lists
    longer than ``long_run``, and buckets of more than ``most`` postings, are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, size = None, [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] < 0:
                    yield _scan_rows(COPIES, 1, [row["block"]])
                    continue
                if row["bucket"] != bucket:
                    yield from scanned(held, size)
                    bucket, held, size = row["bucket"], [], 0
                size += row["n"]
                held.append(row["block"])
                if size > most:  # the bucket is passed on as it comes
                    for block in held:
                        yield _scan_rows(LEFT_OUT, 1, [block])
                    held = []
        yield from scanned(held, size)

    def scanned(held: list[bytes], size: int) -> Iterator[pa.RecordBatch]:
        if not held or size > most:
            return
        found = Bucket(unpack_all(held, POSTING))
        if (found.run > long_run).any():
            yield _scan_rows(LEFT_OUT, 1, [pack(taken(found.posts, found.run > long_run), POSTING)])
            found = Bucket(taken(found.posts, found.run <= long_run))
        if not len(found.rank):
            return
        for rows in found.pieces():
            yield _scan_rows(SCANNED, 1, [pack(taken(found.posts, rows), POSTING)])
        b, a, part = found.first_candidates(threshold, short_run)
        if len(b):
            yield _scan_rows(CANDIDATE, len(b), b=found.place(b), a=found.place(a))
        if len(part):
            yield _scan_rows(CANDIDATE, len(part), b=found.place(part))

    return _by_bucket(posted).mapInArrow(run, f"kind int, block binary, {PAIR_FIELDS}")


def place_slot(doc: np.ndarray, key: np.ndarray, line: np.ndarray, bits: int) -> np.ndarray:
    """Bit of a place in a bitmap of ``2 ** bits``."""
    doc, key, line = (x.astype(np.int64).view(np.uint64) for x in (doc, key, line))
    return (mix((doc * STEP + key) * STEP + line) >> np.uint64(64 - bits)).astype(np.int64)


class Bitmap:
    """Places as bits: all that are in it are found, and some others."""

    def __init__(self, packed: np.ndarray, bits: int):
        self.packed, self.bits = packed, bits

    def has(self, *place: np.ndarray) -> np.ndarray:
        slot = place_slot(*place, self.bits)
        return (self.packed[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


def bitmap_of(places: DataFrame, bits: int) -> Bitmap:
    """A bitmap of rows of three integers; tasks send blocks with a bit, which are joined while they stream by."""
    schema = "part int, found binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = np.zeros(1 << bits - 3, dtype=np.uint8)
        for batch in batches:
            slot = place_slot(*(c.to_numpy(zero_copy_only=False) for c in batch.columns), bits)
            np.bitwise_or.at(packed, slot >> 3, (1 << (slot & 7)).astype(np.uint8))
        for i in range(0, len(packed), BLOCK):
            if packed[i : i + BLOCK].any():
                yield row_of(i // BLOCK, packed[i : i + BLOCK])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != part:
                    if part is not None:
                        yield row_of(part, total)
                    part, total = row["part"], np.zeros(BLOCK, dtype=np.uint8)
                total |= np.frombuffer(row["found"], np.uint8)
        if part is not None:
            yield row_of(part, total)

    def row_of(part: int, block: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block.tobytes()])], names=["part", "found"])

    packed = np.zeros(1 << bits - 3, dtype=np.uint8)
    sent = places.mapInArrow(run, schema).repartition("part").sortWithinPartitions("part").mapInArrow(merge, schema)
    for row in sent.collect():
        packed[row["part"] * BLOCK : (row["part"] + 1) * BLOCK] = np.frombuffer(row["found"], np.uint8)
    return Bitmap(packed, bits)


def candidates_of(blocks: DataFrame, wanted: Bitmap, threshold: float, short_run: int) -> DataFrame:
    """All candidates, in the scanned blocks, of the lines in ``wanted`` and of some others."""
    shared = blocks.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0):
                found = Bucket(unpack(block.as_py(), POSTING))
                b, a = found.candidates_of(shared.value.has(*found.place(np.arange(len(found.of_rank)))), threshold, short_run)
                if len(b):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(found.place(b) + found.place(a), PAIR_TYPES)], names=B + A)

    return blocks.select("block").mapInArrow(run, PAIR_FIELDS)


ROWS = "word int, doc long, key long, line int, n int, at int, bits long"
ROW_SCHEMA = pa.schema([(x.split()[0], pa.int64() if x.endswith("long") else pa.int32()) for x in ROWS.split(", ")])


def _posting_rows(posts: dict[str, np.ndarray]) -> pa.RecordBatch:
    signed = posts | {"word": posts["word"].view(np.int32), "bits": posts["bits"].view(np.int64)}
    return pa.RecordBatch.from_arrays([pa.array(signed[f.name], f.type) for f in ROW_SCHEMA], schema=ROW_SCHEMA)


def as_rows(blocks: DataFrame) -> DataFrame:
    """Blocks of postings as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0):
                yield _posting_rows(unpack(block.as_py(), POSTING))

    return blocks.select("block").mapInArrow(run, ROWS)


def pair_postings(lines: DataFrame, hot: np.ndarray, threshold: float) -> DataFrame:
    """Postings by pairs of words, in place of the long lists of the words in ``hot``.

    Similar sets share two words of their prefixes lengthened by one.  So if
    their first common word is a hot one, they also share a pair of it and
    another word, and lists of pairs are much shorter.
    """
    shared = lines.sparkSession.sparkContext.broadcast(np.sort(hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _buckets_of(batches):
            classes, words, start = _collapsed(rows)
            times = classes["posts"].astype(np.int64)
            own, spot = np.repeat(np.arange(len(times)), times), spans(start, times)
            word, at = words["word"][spot], words["at"][spot]
            core = at < prefix_length(classes["n"].astype(np.int64), threshold)[own]
            chosen = np.flatnonzero(core & np.isin(word.view(np.int32), shared.value))
            # Each chosen word meets every other word of its line.
            first = np.cumsum(times) - times
            count = times[own[chosen]]
            one, two = np.repeat(chosen, count), spans(first[own[chosen]], count)
            one, two = one[one != two], two[one != two]
            pair = (mix(word[one].astype(np.uint64) * STEP + word[two]) >> np.uint64(32)).astype(np.uint32)
            posts = taken({x: classes[x] for x in ("doc", "key", "line", "n", "bits")}, own[one])
            yield _posting_rows(posts | {"word": pair, "at": at[one]})

    return _by_bucket(lines.select("bucket", "classes", "words")).mapInArrow(run, ROWS)


def scan_sorted(posted: DataFrame, threshold: float, long_run: int) -> DataFrame:
    """First candidates in postings as rows, streamed in order of word and place.

    Of a list longer than ``long_run`` that many postings are held, and later
    ones compared with those; the ones without a candidate there come back
    without ``a``, as not fully looked at.
    """
    ordered = posted.repartition("word").sortWithinPartitions("word", "doc", "key", "line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: dict[str, np.ndarray] | None = None  # the beginning of a list that is already scanned
        held: dict[str, np.ndarray] | None = None
        for batch in batches:
            cols = {f.name: batch.column(f.name).to_numpy(zero_copy_only=False) for f in ROW_SCHEMA}
            if head is not None:
                inside = cols["word"] == head["word"][0]
                if inside.any():
                    yield from against(head, taken(cols, inside))
                if inside.all():
                    continue
                head, cols = None, taken(cols, ~inside)
            held = cols if held is None else {x: np.concatenate((held[x], cols[x])) for x in cols}
            cut = np.searchsorted(held["word"], held["word"][-1])
            if len(held["word"]) - cut > long_run:
                yield from found(taken(held, slice(0, cut)))
                head, rest = taken(held, slice(cut, cut + long_run)), taken(held, slice(cut + long_run, None))
                yield from found(head)
                yield from against(head, rest)
                held = None
            elif cut >= CHUNK:
                yield from found(taken(held, slice(0, cut)))
                held = taken(held, slice(cut, None))
        if held is not None:
            yield from found(held)

    def arrays(p: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
        same = np.zeros(len(p["word"]), dtype=bool)
        for x in ("doc", "key", "line"):  # a class may be in a list twice, if two codes are equal
            same[1:] |= p[x][1:] != p[x][:-1]
        return p["word"], np.cumsum(same), p["n"].astype(np.int64), p["at"].astype(np.int64), p["bits"].view(np.uint64)

    def found(p: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        words, where, sizes = np.unique(p["word"], return_inverse=True, return_counts=True)
        for word in words[sizes > long_run]:
            whole = taken(p, p["word"] == word)
            yield from found(taken(whole, slice(0, long_run)))
            yield from against(taken(whole, slice(0, long_run)), taken(whole, slice(long_run, None)))
        p = taken(p, sizes[where] <= long_run)
        if len(p["word"]):
            b, a = first_of_lists(*arrays(p), threshold)
            if len(b):
                yield pairs(p, b, p, a)

    def against(head: dict[str, np.ndarray], rest: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        size, both = len(head["word"]), {x: np.concatenate((head[x], rest[x])) for x in head}
        columns = arrays(both)[1:]
        rows = np.arange(size, len(both["word"]))
        for start in range(0, len(rows), TABLE):
            left = rows[start : start + TABLE]
            for low in range(0, size, TABLE):
                cols = np.arange(low, min(low + TABLE, size))
                ok = _table(left, cols, *columns, threshold)
                hit = ok.any(axis=1)
                if hit.any():
                    yield pairs(both, left[hit], both, cols[ok[hit].argmax(axis=1)])
                left = left[~hit]
                if not len(left):
                    break
            if len(left):
                yield pairs(both, left)

    def pairs(p: dict, b: np.ndarray, q: dict | None = None, a: np.ndarray | None = None) -> pa.RecordBatch:
        later = [pa.array(p[x][b], t) for x, t in zip(("doc", "key", "line"), PAIR_TYPES)]
        earlier = [pa.nulls(len(b), t) if q is None else pa.array(q[x][a], t) for x, t in zip(("doc", "key", "line"), PAIR_TYPES)]
        return pa.RecordBatch.from_arrays(later + earlier, names=B + A)

    return ordered.select(*ROW_SCHEMA.names).mapInArrow(run, PAIR_FIELDS)


def joined_pairs(posted: DataFrame, some: DataFrame, threshold: float) -> DataFrame:
    """All earlier lines that may match the lines of ``some``, postings as rows both."""
    left, right = posted.alias("l"), some.alias("r")
    c = F.col
    place = lambda x: F.struct(*(c(f"{x}.{y}") for y in ("doc", "key", "line")))
    asked = F.ceil(F.lit(threshold / (1 + threshold)) * (c("l.n") + c("r.n")) - F.lit(1e-9))
    near = (
        (c("l.word") == c("r.word"))
        & (place("l") < place("r"))
        & (F.least("l.n", "r.n") >= F.lit(threshold) * F.greatest("l.n", "r.n") - F.lit(1e-9))
        & (F.least(c("l.n") - c("l.at"), c("r.n") - c("r.at")) >= asked)
        & (c("l.n") + c("r.n") - F.bit_count(c("l.bits").bitwiseXOR(c("r.bits"))) >= 2 * asked)
    )
    names = [c(f"{x}.{y}").alias(f"{z}_{y}") for x, z in (("r", "b"), ("l", "a")) for y in ("doc", "key", "line")]
    return left.join(right, near).select(*names).distinct()


#: Longs of the wide parity bitmap of a line.
SKETCH = [f"s{i}" for i in range(8)]
TEXTS = pa.schema(
    [("doc", pa.int64()), ("key", pa.int64()), ("line", pa.int32()), ("n", pa.int32()), *((s, pa.int64()) for s in SKETCH), ("text", pa.string())]
)


def sketches(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The number of different words of each line, and their parities in ``64 * len(SKETCH)`` bits."""
    hashes, line = hash_words(b"\n".join(lines))
    order = np.lexsort((hashes, line))
    hashes, line = hashes[order], line[order]
    new = np.append(True, (hashes[1:] != hashes[:-1]) | (line[1:] != line[:-1]))[: len(line)]
    hashes, line = hashes[new], line[new]
    found = np.zeros((len(lines), len(SKETCH)), dtype=np.uint64)
    bit = np.uint64(1) << (hashes & np.uint64(63))
    np.bitwise_xor.at(found, (line, ((hashes >> np.uint64(6)) % np.uint64(len(SKETCH))).astype(np.int64)), bit)
    return np.bincount(line, minlength=len(lines)), found


def texts_of_lines(keyed: DataFrame, wanted: Bitmap, unique: bool) -> DataFrame:
    """Place, size, sketch and text of a superset of the lines in ``wanted``, each once; ``unique``: no id is repeated."""
    shared = keyed.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256).to_pydict()
                docs = [(d, k, t.split(b"\n")) for d, k, t in zip(*part.values()) if d is not None and t]
                if not docs:
                    continue
                sizes = np.array([len(lines) for *_, lines in docs])
                ids, keys = (np.repeat(np.array([d[i] for d in docs], np.int64), sizes) for i in (0, 1))
                numbers = spans(np.zeros(len(docs), np.int64), sizes)
                hit = np.flatnonzero(shared.value.has(ids, keys, numbers))
                every = [line for *_, own in docs for line in own]
                lines = [every[i] for i in hit.tolist()]
                n, bits = sketches(lines)
                columns = [ids[hit], keys[hit], numbers[hit], n, *bits.view(np.int64).T, pa.array(lines, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, TEXTS)], schema=TEXTS)

    ddl = "doc long, key long, line int, n int, " + ", ".join(f"{s} long" for s in SKETCH) + ", text string"
    found = _raw(keyed).mapInArrow(run, ddl)
    return found if unique else found.dropDuplicates(["doc", "key", "line"])


def likely(pairs: DataFrame, read: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose sketches allow the threshold; parities differ in at most as many bits as the sets in words."""
    both = pairs.select(*B, *A)
    for x in "ba":
        renamed = [F.col(c).alias(f"{x}_{c}") for c in ("doc", "key", "line", "n", *SKETCH)]
        both = both.join(read.select(*renamed), [f"{x}_doc", f"{x}_key", f"{x}_line"])
    apart = sum((F.bit_count(F.col(f"a_{s}").bitwiseXOR(F.col(f"b_{s}"))) for s in SKETCH), F.lit(0))
    words = F.col("a_n") + F.col("b_n")
    asked = F.ceil(F.lit(threshold / (1 + threshold)) * words - F.lit(1e-9))
    return both.where(words - apart >= 2 * asked).select(*B, *A)


def lines_of(pairs: DataFrame) -> DataFrame:
    """``doc, key, line`` of both sides of all pairs."""
    sides = [pairs.select(*(F.col(c).alias(c[2:]) for c in side)) for side in (B, A)]
    return sides[0].union(sides[1]).distinct()


def only_for(read: DataFrame, pairs: DataFrame) -> DataFrame:
    """The texts that ``pairs`` ask for."""
    return saved(read.join(broadcast_if_small(saved(lines_of(pairs))), ["doc", "key", "line"], "left_semi").select("doc", "key", "line", "text"))


def word_set(line: str | None) -> frozenset[bytes]:
    """The set of words of a line, as the rest of this module sees it."""
    return frozenset((line or "").encode().lower().split())


def verified(pairs: DataFrame, read: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs with ``ok``: whether the word sets of the two lines are as similar as asked."""
    both = pairs.select(*B, *A)
    for x in "ba":
        both = both.join(read.toDF(f"{x}_doc", f"{x}_key", f"{x}_line", f"{x}_text"), [f"{x}_doc", f"{x}_key", f"{x}_line"])
    fields = pa.schema([*zip(B + A, PAIR_TYPES), ("ok", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                sets: dict[str, frozenset] = {}
                for a, b in zip(part.column("a_text").to_pylist(), part.column("b_text").to_pylist()):
                    x, y = (sets.get(t) or sets.setdefault(t, word_set(t)) for t in (a, b))
                    common = len(x & y)
                    ok.append(common >= threshold * (len(x) + len(y) - common) - 1e-9)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in B + A), pa.array(ok, pa.bool_())], schema=fields)

    return both.select(*B, *A, "a_text", "b_text").mapInArrow(run, f"{PAIR_FIELDS}, ok boolean")


def _first(pairs: DataFrame) -> DataFrame:
    """The earliest ``a`` of each ``b``."""
    return pairs.groupBy(*B).agg(F.min(F.struct(*A)).alias("a")).select(*B, "a.*")


def earlier_matches(
    keyed: DataFrame, lines: DataFrame, scanned: DataFrame, rows: int, unique: bool, threshold: float, short_run: int, long_run: int
) -> DataFrame:
    """The earliest match ``a`` of each first line ``b`` of a class that has one.

    The scan gives each line its first candidate, which mostly is its match;
    only lines whose first candidate fails, or that a long list leaves not fully
    looked at, are compared with all their candidates.  Pairs are compared by
    sketch before their texts are.
    """
    bits = bits_for(rows, 128, LEAST_FOUND_BITS, MOST_FOUND_BITS)
    found = scanned.where(F.col("kind") == CANDIDATE).select(*B, *A)
    left_out = scanned.where(F.col("kind") == LEFT_OUT)
    posted = unseen = None
    if not left_out.isEmpty():
        posted = as_rows(left_out)
        long_lists = saved(posted.groupBy("word").count().where(F.col("count") > long_run).select("word"))
        hot = [r["word"] for r in long_lists.limit(MOST_HOT + 1).collect()]
        if 0 < len(hot) <= MOST_HOT:
            paired = pair_postings(lines, np.array(hot, dtype=np.int32), threshold)
            posted = posted.join(F.broadcast(long_lists), "word", "left_anti").select(*ROW_SCHEMA.names).unionByName(paired)
        posted = saved(posted)
        by_row = saved(scan_sorted(posted, threshold, long_run))
        found = found.unionByName(by_row)
        unseen = saved(by_row.where("a_doc is null").select(*B).distinct())
    named = [found.select(*B), found.where("a_doc is not null").select(*A)]
    read = saved(texts_of_lines(keyed, bitmap_of(named[0].union(named[1]), bits), unique))
    tried = saved(_first(found.where("a_doc is not null")))
    near = saved(likely(tried, read, threshold))
    good = saved(verified(near, only_for(read, near), threshold).where("ok").drop("ok"))
    rest = tried.join(good.select(*B), B, "left_anti").select(*B, F.struct(*A).alias("last"))
    if unseen is not None:
        rest = rest.join(unseen, B, "left_anti").unionByName(unseen.withColumn("last", F.lit(None).cast(rest.schema["last"].dataType)))
    rest = saved(rest)
    if rest.isEmpty():
        return good
    pairs = candidates_of(scanned.where(F.col("kind") == SCANNED), bitmap_of(rest.select(*B), bits), threshold, short_run)
    if posted is not None:
        of_rest = posted.join(broadcast_if_small(rest.select(*(F.col(x).alias(x[2:]) for x in B))), ["doc", "key", "line"], "left_semi")
        some = broadcast_if_small(saved(of_rest.select(*ROW_SCHEMA.names)), SOME_BYTES)
        pairs = pairs.unionByName(joined_pairs(posted, some, threshold))
    untried = F.col("last").isNull() | (F.struct(*A) > F.col("last"))
    pairs = saved(pairs.join(broadcast_if_small(rest), B).where(untried).select(*B, *A).distinct())
    unread = saved(lines_of(pairs).join(read.select("doc", "key", "line"), ["doc", "key", "line"], "left_anti"))
    if not unread.isEmpty():
        more = texts_of_lines(keyed, bitmap_of(unread, bits), unique).join(read.select("doc", "key", "line"), ["doc", "key", "line"], "left_anti")
        read = read.unionByName(saved(more.select(*read.columns)))
    near = saved(likely(pairs, read, threshold), release=True)
    free(pairs)
    return _first(good.unionByName(_earliest(near, only_for(read, near), threshold)))


def _earliest(pairs: DataFrame, read: DataFrame, threshold: float) -> DataFrame:
    """The earliest verified pair of each ``b``.

    A few rounds try each line's next candidate, which settles most lines with
    one comparison each; what is left then is compared in full.
    """
    found = None
    for _ in range(ROUNDS):
        tried = saved(verified(_first(pairs), read, threshold))
        good = tried.where("ok").drop("ok")
        found = good if found is None else found.unionByName(good)
        failed = tried.where(~F.col("ok")).select(*B, F.struct(*A).alias("last"))
        before, pairs = pairs, saved(pairs.join(failed, B).where(F.struct(*A) > F.col("last")).drop("last"))
        free(before)
        if pairs.isEmpty():
            return found
    return found.unionByName(_first(verified(pairs, read, threshold).where("ok").drop("ok")))


def members_of(blocks: DataFrame, column: str, wanted: Bitmap | None = None) -> DataFrame:
    """``k1, k2, doc, key, line`` from blocks of members: of classes in ``wanted`` and some others, or of all."""
    shared = blocks.sparkSession.sparkContext.broadcast(wanted)
    types = [pa.int64()] * 4 + [pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0):
                lines = unpack(block.as_py(), MEMBER)
                lines |= {k: lines[k].view(np.int64) for k in ("k1", "k2")}
                if shared.value is not None:
                    lines = taken(lines, shared.value.has(lines["k1"], lines["k2"], np.zeros(len(lines["k1"]), np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(lines[x], t) for (x, _), t in zip(MEMBER, types)], names=[x for x, _ in MEMBER])

    return blocks.select(column).mapInArrow(run, "k1 long, k2 long, doc long, key long, line int")


def find_later_matches(
    docs: DataFrame, threshold: float = THRESHOLD, short_run: int = SHORT_RUN, long_run: int = LONG_RUN, min_words: int = MIN_WORDS
) -> DataFrame:
    """``doc_id, row_key, line_no, match_doc_id, match_row_key, match_line_no``: every line to remove and its earliest match."""
    key = unused(docs, "_ld_key")
    repeated = repeated_ids(docs)
    keyed = with_row_key(docs, key, repeated).select("doc_id", F.col(key).alias("row_key"), "text")
    rows = docs.count()
    ranks, words = rank_words(keyed, min_words, bits_for(rows, 32, LEAST_COUNTER_BITS, MOST_COUNTER_BITS))
    buckets = words // BUCKET_WORDS + 1
    lines = saved(describe_lines(keyed, ranks, buckets, threshold, min_words), release=True)
    scanned = saved(scan_blocks(post_classes(lines, buckets, threshold), threshold, short_run, long_run), release=True)
    matches = saved(earlier_matches(keyed, lines, scanned, rows, repeated is None, threshold, short_run, long_run))
    place = ["doc", "key", "line"]
    copied = saved(members_of(scanned.where(F.col("kind") == COPIES), "block"))
    free(scanned)
    with_match = copied.join(matches.toDF(*place, *A), place, "left")
    first, match = F.struct(*place), F.coalesce(F.when(F.col("a_doc").isNotNull(), F.struct(*(F.col(a).alias(x) for a, x in zip(A, place)))), F.struct(*place))
    target = broadcast_if_small(saved(with_match.select("k1", "k2", first.alias("first"), match.alias("match"))))
    bits = bits_for(rows, 128, LEAST_FOUND_BITS, MOST_FOUND_BITS)
    members = members_of(lines, "members", bitmap_of(copied.select("k1", "k2", F.lit(0)), bits))
    judged = members.join(target, ["k1", "k2"])
    later = judged.where((F.struct(*place) != F.col("first")) | (F.col("match") != F.col("first"))).select(*place, "match.*")
    single = matches.join(copied.toDF("k1", "k2", *B).select(*B), B, "left_anti")
    gone = later.toDF(*B, *A).unionByName(single).distinct()
    names = ("doc_id", "row_key", "line_no")
    gone = saved(gone.toDF(*names, *(f"match_{x}" for x in names)), release=True)
    free(lines, copied, matches)
    return gone


def line_report(docs: DataFrame, threshold: float = THRESHOLD, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, n_lines, n_removed, removed`` for every row of ``docs``; ``removed`` lists lines and matches."""
    gone = find_later_matches(docs, threshold, min_words=min_words)
    by_doc = gone.groupBy("doc_id", F.col("row_key").alias("_ld_key")).agg(
        F.sort_array(F.collect_list(F.struct("line_no", "match_doc_id", "match_line_no"))).alias("removed")
    )
    text = F.coalesce("text", F.lit(""))
    count = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    sized = with_row_key(docs.select("doc_id", "text"), "_ld_key", repeated_ids(docs)).select("doc_id", "_ld_key", count.alias("n_lines"))
    return sized.join(by_doc, ["doc_id", "_ld_key"], "left").select(
        "doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).alias("n_removed"), "removed"
    )


def remove_later_lines(docs: DataFrame, threshold: float = THRESHOLD, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the lines that repeat earlier ones.

    A document of which no word is left, and only such a one, goes: all of it
    is told earlier.  Documents that lose nothing are unchanged.
    """
    key, lost = unused(docs, "_ld_key"), unused(docs, "_ld_gone")
    gone = find_later_matches(docs, threshold, min_words=min_words)
    gone = gone.groupBy("doc_id", F.col("row_key").alias(key)).agg(F.collect_set("line_no").alias(lost))
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains(F.col(lost), i)), "\n")
    text = F.when(F.col(lost).isNull(), F.col("text")).otherwise(kept)
    columns = [text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    cut = with_row_key(docs, key, repeated_ids(docs)).join(gone, ["doc_id", key], "left").select(*columns, lost)
    return cut.where(F.col(lost).isNull() | F.col("text").rlike("[^\\x20\\x09-\\x0D]")).drop(lost)
