"""Jaccard join of documents on word n-grams, by prefixes under several global orders.

Documents with equal sets are one class. Under any global order of the n-grams, two sets that are similar
enough share one of their first few n-grams, and several of some more. The first order puts rare n-grams
first (counts of hash buckets over all documents) and makes candidates of classes that share such an n-gram
so early in both that enough n-grams can follow; candidates must then share enough of a longer prefix under
two more, independent orders before their sets are compared. Only candidates whose sketches (parities of hash
buckets) differ in no more bits than similar sets can differ in n-grams have their sets read at all.

Components do not need all links: the classes of an n-gram are first compared with one pivot, the class that
has it earliest, and only pairs that are still in different components go on.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from custlytics.llm.common import gathered, hash_words, map_batches, released, settled, word_codes
from custlytics.llm.components import components
from custlytics.session import forget, stored

SHINGLE_WORDS = 4
#: Least similarity, in hundredths.
SIMILARITY = 85
#: Buckets of the n-gram counts, as a power of two, and the parts in which tasks return them.
BUCKET_BITS, COUNT_PARTS = 22, 64
#: Rows of one n-gram that may meet in one task; more are dealt out by a second key.
ROWS_PER_TASK = 200_000
#: Pairs per row of the first round up to which all open pairs are compared at once, and the most rounds
#: of comparisons with pivots before that.
PAIRS_PER_ROW, PIVOT_ROUNDS = 1, 8
#: So many times as many may be compared at once after a round that found no link: pivots no longer help.
AFTER_NO_LINK = 8
#: Bits of a sketch per n-gram at least (the next power of two), and places in the map of the documents to read.
SKETCH_BITS, READER_PLACES = 2, 1 << 25

_BASE = 0x9E3779B97F4A7C15
#: Odd factors that give the second and third order.
_ORDERS = (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
#: The factor that gives the places of a sketch.
_SKETCH = 0xFF51AFD7ED558CCD
_MASK = 2**64 - 1

CLASSES = "doc_id bigint, c bigint, c2 bigint, n bigint, sketch array<bigint>, part int, counts binary"
PREFIXES = "token bigint, salts int, c bigint, n int, reach int"
SETS = "c bigint, c2 bigint, n int, second array<int>, third array<int>, grams array<bigint>"


def shingle_sets(texts: pa.Array, k: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """The sorted set of 64-bit hashes of each text's k-word shingles, words in lower case (A-Z).

    Fewer words are one shingle together, no words none. A null text has no words."""
    codes, starts, words = word_codes(texts, lower=True)
    hashes = hash_words(words)[codes] if len(codes) else np.zeros(0, np.uint64)
    windows = np.zeros(max(len(hashes) - k + 1, 0), np.uint64)
    for j in range(k):
        windows += hashes[j : j + len(windows)] * np.uint64(pow(_BASE, k - 1 - j, 2**64))
    out = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(windows[a : b - k + 1]))
        elif b > a:
            short = xxhash.xxh3_64_intdigest(hashes[a:b].tobytes(), seed=b - a)
            out.append(np.array([short], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def class_of(grams: np.ndarray) -> tuple[int, int]:
    return tuple(int(x) for x in np.frombuffer(xxhash.xxh3_128_digest(grams.tobytes()), np.int64))


def sketch(grams: np.ndarray) -> np.ndarray:
    """The parity of the number of n-grams in each of 64, 128, ... hash buckets, 64 of them to a number.

    Each n-gram that only one of two sets has changes one bit: sketches of one length differ in at most as many
    bits. The halves of a sketch, xor-ed, are the sketch of half the length."""
    bits = max(64, 1 << (SKETCH_BITS * len(grams) - 1).bit_length())
    places = (grams * np.uint64(_SKETCH) >> np.uint64(32)) & np.uint64(bits - 1)
    odd = np.bincount(places.astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view("<i8")


def prefix_length(n: int, similarity: int = SIMILARITY, shared: int = 1) -> int:
    """So many n-grams, under any order, that two similar sets share ``shared`` of them."""
    return min(n, n - (similarity * n + 99) // 100 + shared) if n else 0


def reaches(n: int, similarity: int = SIMILARITY) -> np.ndarray:
    """For each place of the prefix of a set of ``n``, the largest set that can be similar to it and share no
    earlier n-gram: all that they share lies from there on."""
    left = n - np.arange(prefix_length(n, similarity))
    return left * (100 + similarity) // similarity - n


#: Under the second and third order two similar sets share one n-gram more for each so many of the
#: smaller set.
GRAMS_PER_SHARED = 20


def _other_prefixes(grams: np.ndarray, similarity: int) -> list[np.ndarray]:
    """The upper halves of the first n-grams under the second and the third order."""
    first = prefix_length(len(grams), similarity, 1 + len(grams) // GRAMS_PER_SHARED)
    return [(np.sort(grams * np.uint64(f))[:first] >> np.uint64(32)).astype(np.uint32).view(np.int32) for f in _ORDERS]


def _classes(k: int):
    """Rows of (doc_id, class, size, sketch), and each task's counts of n-gram buckets."""
    names = [c.split()[0] for c in CLASSES.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.binary()]

    def made(*columns) -> pa.RecordBatch:
        filled = [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(filled, names=names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BUCKET_BITS, np.int64)
        shift = np.uint64(64 - BUCKET_BITS)
        for rows in gathered(batches, "text"):
            sets = shingle_sets(rows.column("text"), k)
            if not sets:
                continue
            counts += np.bincount((np.concatenate(sets) >> shift).astype(np.int64), minlength=len(counts))
            c, c2 = zip(*map(class_of, sets), strict=True)
            none = [None] * len(sets)
            yield made(rows.column("doc_id"), c, c2, [len(s) for s in sets], [sketch(s) if len(s) else None for s in sets], none, none)
        if counts.any():
            none = [None] * COUNT_PARTS
            yield made(*[none] * 5, range(COUNT_PARTS), [zlib.compress(p.astype("<i8").tobytes(), 1) for p in np.split(counts, COUNT_PARTS)])

    return run


def _summed(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for rows in parts:
        for counts in rows.column("counts").to_pylist():
            more = np.frombuffer(zlib.decompress(counts), "<i8")
            total = more.copy() if total is None else total + more
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["part", "counts"])


def _prefixes(k: int, similarity: int, counts, rows_per_task: int):
    """The first n-grams of each document under the order by bucket count, then hash."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_bucket, shift = counts.value, np.uint64(64 - BUCKET_BITS)
        for rows in batches:
            tokens, ids, sizes, reach = [], [], [], []
            for grams in shingle_sets(rows.column("text"), k):
                first = prefix_length(len(grams), similarity)
                order = np.lexsort((grams, of_bucket[(grams >> shift).astype(np.int64)]))[:first]
                tokens.append(grams[order])
                ids.append(np.full(first, class_of(grams)[0], np.int64))
                sizes.append(np.full(first, len(grams), np.int32))
                reach.append(reaches(len(grams), similarity).astype(np.int32))
            if tokens:
                tokens = np.concatenate(tokens)
                salts = -(-of_bucket[(tokens >> shift).astype(np.int64)].astype(np.int64) // rows_per_task)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tokens.view(np.int64)), pa.array(salts.astype(np.int32)), *(pa.array(np.concatenate(x)) for x in (ids, sizes, reach))],
                    names=["token", "salts", "c", "n", "reach"],
                )

    return run


def _sets(k: int, similarity: int):
    """Whole sets and their prefixes under the other two orders; a class met again is left out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for rows in batches:
            columns: list[list] = [[] for _ in range(6)]
            for grams in shingle_sets(rows.column("text"), k):
                key = class_of(grams)
                if key not in seen:
                    seen.add(key)
                    for column, value in zip(columns, (*key, len(grams), *_other_prefixes(grams, similarity), grams.view(np.int64)), strict=True):
                        column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.list_(pa.int32())] * 2, pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in SETS.split(", ")])

    return run


def _bucket_counts(parts: DataFrame) -> np.ndarray:
    """The tasks' counts, summed part by part; the driver gets one array of a fixed size."""
    found = parts.groupBy("part").applyInArrow(_summed, "part int, counts binary").collect()
    counts = np.zeros((COUNT_PARTS, (1 << BUCKET_BITS) // COUNT_PARTS), np.int64)
    for row in found:
        counts[row.part] = np.frombuffer(zlib.decompress(row.counts), "<i8")
    return np.minimum(counts.reshape(-1), 2**31 - 1).astype(np.int32)


def _can_meet(own: str) -> Column:
    """Whether a row can pair with a row of its n-gram that has another ``own``: the smallest set among those
    is within its reach, and it is within the longest reach among those."""
    least = F.when(F.col(own) != F.col(f"low.{own}"), F.col("low.n")).otherwise(F.col("low_n"))
    most = F.when(F.col(own) != F.col(f"high.{own}"), F.col("high.reach")).otherwise(F.col("high_reach"))
    return (F.col("reach") >= least) & (F.col("n") <= most)


def _ends(own: str) -> list[Column]:
    return [F.min(F.struct("n", own)), F.max(F.struct("reach", own))]


def _other_ends(own: str) -> list[Column]:
    """An end may be the row's own; then the end of the others counts."""
    return [F.min(F.when(F.col(own) != F.col(f"low.{own}"), F.col("n"))), F.max(F.when(F.col(own) != F.col(f"high.{own}"), F.col("reach")))]


def _shared(prefixes: DataFrame) -> DataFrame:
    """Prefix rows whose n-gram is in the prefix of another class that they can pair with. Very frequent n-grams
    are dealt out by class as well, and kept without that test."""
    within = Window.partitionBy("token", "salt")
    low, high = (end.over(within) for end in _ends("c"))
    low_n, high_reach = (end.over(within) for end in _other_ends("c"))
    return (
        prefixes.withColumn("salt", F.pmod("c", "salts"))
        .repartition("token", "salt")  # before the windows' structs are made, which need not travel
        .withColumns({"low": low, "high": high})
        .withColumns({"low_n": low_n, "high_reach": high_reach})
        .filter(_can_meet("c") | (F.col("salts") > 1))
        .select("token", "c", "n", "reach")
        .distinct()
    )


def _side(table: DataFrame, name: str, *columns: str) -> DataFrame:
    return table.select(F.col("id").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in columns])


def _differing_bits(one: Column, other: Column) -> Column:
    """Bits in which two sketches differ, the longer one folded to the length of the other. Sizes of similar sets
    are so near that one is at most twice as long."""

    def xor(x: Column, y: Column) -> Column:
        return x.bitwiseXOR(y)

    def fitted(x: Column, to: Column) -> Column:
        half = F.floor(F.size(x) / 2).cast("int")
        return F.when(F.size(x) > F.size(to), F.zip_with(F.slice(x, 1, half), F.slice(x, half + 1, half), xor)).otherwise(x)

    return F.aggregate(F.zip_with(fitted(one, other), fitted(other, one), xor), F.lit(0), lambda n, x: n + F.bit_count(x))


def _near(pairs: DataFrame, sketches: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b) of classes whose sketches do not tell that their sets differ in too many n-grams."""
    left, right = (_side(sketches, name, "n", "sketch") for name in "ab")
    both = F.col("n_a") + F.col("n_b")
    most = both - 2 * F.floor((similarity * both + 99 + similarity) / (100 + similarity))
    near = _differing_bits(F.col("sketch_a"), F.col("sketch_b")) <= most
    return pairs.join(left, "a").join(right, "b").filter(near).select("a", "b")


def _candidates(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that share enough of their prefixes under the other two orders as well."""
    left, right = (_side(sets, name, "n", "second", "third") for name in "ab")
    least = F.floor(F.least("n_a", "n_b") / GRAMS_PER_SHARED) + 1

    def enough(order: str) -> Column:
        one, other = F.col(f"{order}_a"), F.col(f"{order}_b")
        # Halves that are equal by chance inside one set count once in the intersection.
        doubled = F.size(one) - F.size(F.array_distinct(one))
        return F.size(F.array_intersect(one, other)) + doubled >= least

    return pairs.join(left, "a").join(right, "b").filter(enough("second") & enough("third")).select("a", "b")


def _links(candidates: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The candidates whose sets are similar enough."""
    left, right = (_side(sets, name, "n", "grams") for name in "ab")
    common = F.size(F.array_intersect("grams_a", "grams_b"))
    similar = 100 * common >= similarity * (F.col("n_a") + F.col("n_b") - common)
    return candidates.join(left, "a").join(right, "b").filter(similar).select("a", "b")


def _named(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with the components known by now; the rows of a class meet its label as one."""
    of_class = rows.groupBy("id", "n").agg(F.collect_list(F.struct("token", "reach")).alias("prefix"))
    named = of_class.join(labels.select(F.col("node").alias("id"), "component"), "id", "left")
    return named.select("id", "n", F.coalesce("component", "id").alias("comp"), F.inline("prefix"))


def _open_rows(rows: DataFrame) -> DataFrame:
    """Rows (token, id, n, reach, comp) that can pair with a row of their n-gram in another component."""
    per = rows.groupBy("token", "comp").agg(F.min("n").alias("n"), F.max("reach").alias("reach"))
    low, high = _ends("comp")
    low_n, high_reach = _other_ends("comp")
    ends = per.groupBy("token").agg(low.alias("low"), high.alias("high"))
    others = per.join(ends, "token").groupBy("token", "low", "high").agg(low_n.alias("low_n"), high_reach.alias("high_reach"))
    met = rows.join(others.filter("low_n is not null"), "token").filter(_can_meet("comp"))
    return met.select("token", "id", "n", "reach", "comp")


def _open_pairs(rows: DataFrame) -> tuple[int, int]:
    """Rows, and pairs of rows that share an n-gram but not a component."""
    per = rows.groupBy("token", "comp").agg(F.count("*").alias("k"))
    per = per.groupBy("token").agg(F.sum("k").alias("all"), F.sum(F.col("k") * F.col("k")).alias("same"))
    found = per.agg(F.sum("all"), F.sum((F.col("all") * F.col("all") - F.col("same")) / 2)).first()
    return int(found[0] or 0), int(found[1] or 0)


def _pivots(rows: DataFrame, attempt: int) -> DataFrame:
    """One row of each n-gram: first that with the longest reach for its size, which has the n-gram earliest,
    then another in each round."""
    rank = F.struct(F.lit(0.0) if attempt else -F.col("reach") / F.col("n"), F.xxhash64("id", F.lit(attempt)))
    chosen = rows.groupBy("token").agg(F.min(F.struct(rank.alias("rank"), "id", "n", "reach", "comp")).alias("p"))
    return chosen.select("token", "p.id", "p.n", "p.reach", "p.comp")


def _pairs(left: DataFrame, right: DataFrame, once: bool) -> DataFrame:
    """Distinct pairs (a, b) of classes of one n-gram in different components, each within the other's reach.
    ``once``: both sides are the same rows, of which each pair is made once."""
    a, b = (side.select("token", *[F.col(c).alias(f"{c}_{name}") for c in ("id", "n", "reach", "comp")]) for side, name in ((left, "a"), (right, "b")))
    fits = (F.col("comp_a") != F.col("comp_b")) & (F.col("n_b") <= F.col("reach_a")) & (F.col("n_a") <= F.col("reach_b"))
    both = a.join(b, "token").filter(fits & (F.col("id_a") < F.col("id_b")) if once else fits)
    return both.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()


def _readers(docs: DataFrame, readers: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is a ``reader``. A map of bits, of a fixed size whatever the number of
    readers, leaves out most others before they are dealt out."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(READER_PLACES))
    places = readers.select(F.pmod(F.xxhash64("reader"), F.lit(READER_PLACES)).alias("place"))
    maps = places.groupBy(F.bitmap_bucket_number("place").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    some = docs.join(F.broadcast(maps), (F.bitmap_bucket_number(place) == F.col("block")) & (F.getbit(byte, (at % 8).cast("int")) == 1), "left_semi")
    return some.join(readers.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("reader")), "left_semi")


def similar_classes(
    rows: DataFrame, sketches: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: int, pairs_per_row: int, pivot_rounds: int
) -> DataFrame | None:
    """(node, component) of the classes that have a link. ``sketches`` are (id, n, sketch) of all classes;
    ``sets_of`` fetches the sets of some, and is asked in each round for those with a pair that may link."""
    labels = most = None
    rows = rows.withColumn("comp", F.col("id"))
    for attempt in range(pivot_rounds + 1):
        if attempt:
            if labels is not None:
                named = stored(_named(rows, labels))
            rows = settled(_open_rows(rows if labels is None else named))
            if labels is not None:
                forget(named)
        else:
            rows = settled(rows)
        n_rows, n_pairs = _open_pairs(rows)
        if not n_rows:
            break
        most = pairs_per_row * n_rows if most is None else most
        last = n_pairs <= most or attempt == pivot_rounds
        pairs = _pairs(rows, rows, True) if last else _pairs(rows, _pivots(rows, attempt), False)
        pairs, known = settled(_near(pairs, sketches, similarity)), labels
        if not pairs.isEmpty():
            sets = settled(sets_of(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()))
            found = settled(_links(_candidates(pairs, sets), sets, similarity))
            del sets
            released(rows.sparkSession)
            if not found.isEmpty():
                # What is known already goes on as a star around the least class of each component.
                labels = components(found if labels is None else found.union(labels.select("node", "component")))
        if last:
            break
        if labels is known:
            most *= AFTER_NO_LINK
    return labels


def near_duplicates(
    docs: DataFrame, words: int = SHINGLE_WORDS, similarity: int = SIMILARITY, rows_per_task: int = ROWS_PER_TASK,
    pairs_per_row: int = PAIRS_PER_ROW, pivot_rounds: int = PIVOT_ROUNDS,
) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id), one row per row of ``docs``.

    A document's set are the distinct shingles of ``words`` words (``[^\\x20\\x09-\\x0D]+``, A-Z in lower
    case); fewer words are one shingle. Documents link when the Jaccard similarity of their sets is at
    least ``similarity`` hundredths; ``component_id`` is the least doc_id reachable by links, ``class_id``
    the least doc_id with an equal set.

    Documents without words (null or empty text) have no shingles and link with nothing: both ids are
    their own. Equal rows and repeated ids are fine. A null doc_id can link like any other; a component
    is named by its least id that is not null. An empty table gives no rows; other columns are not read.

    Nothing is capped: the classes of an n-gram are compared with pivots, round by round, while more than
    ``pairs_per_row`` pairs per row are open (more after rounds without a link), and what is still open after
    ``pivot_rounds`` rounds pair by pair.
    """
    slim = docs.select("doc_id", "text")
    session, node = docs.sparkSession, F.struct("c", "c2")
    first = stored(map_batches(slim, _classes(words), CLASSES))
    counts = _bucket_counts(first.filter("part is not null").select("part", "counts"))
    each = first.filter("part is null")
    of_doc = settled(each.select("doc_id", "c", "c2", "n"))
    sent = session.sparkContext.broadcast(counts)  # of a fixed size
    shared = settled(_shared(map_batches(slim, _prefixes(words, similarity, sent, rows_per_task), PREFIXES)))

    some = each.join(shared.select("c").distinct(), "c", "left_semi").groupBy("c", "c2")
    classes = some.agg(F.min("doc_id").alias("reader"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = settled(classes.withColumn("id", node))
    forget(first)
    rows = shared.join(classes.select("c", "id"), "c").select("token", "id", "n", "reach")

    def sets_of(wanted: DataFrame) -> DataFrame:
        """Read from one document of each class."""
        readers = classes.join(wanted, "id", "left_semi").select("reader").distinct()
        return map_batches(_readers(slim, readers), _sets(words, similarity), SETS).withColumn("id", node)

    labels = similar_classes(rows, classes.select("id", "n", "sketch"), sets_of, similarity, pairs_per_row, pivot_rounds)

    per_class = of_doc.filter("n > 0").groupBy("c", "c2").agg(F.min("doc_id").alias("class_id")).withColumn("id", node)
    if labels is not None:
        per_class = per_class.join(labels.withColumnRenamed("node", "id"), "id", "left")
    else:
        per_class = per_class.withColumn("component", F.lit(None).cast("struct<c:bigint,c2:bigint>"))
    per_class = per_class.withColumn("component", F.coalesce("component", "id"))
    least = per_class.groupBy("component").agg(F.min("class_id").alias("component_id"))
    per_class = per_class.join(least, "component").select("c", "c2", "class_id", "component_id")
    linked = of_doc.filter("n > 0").join(per_class, ["c", "c2"]).select("doc_id", F.col("n").alias("n_shingles"), "class_id", "component_id")
    alone = of_doc.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def keep_representatives(docs: DataFrame, **options: int) -> DataFrame:
    """The rows of ``docs`` whose document is the one of least id in its component, unchanged.

    Documents without words link with nothing and stay. Equal rows of (doc_id, text) are one document, of
    which one row stays."""
    near = near_duplicates(docs, **options).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    chosen = settled(near.groupBy(F.col("doc_id").alias("chosen")).agg(F.count("*").alias("times")))
    kept = docs.join(chosen.select("chosen").hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("chosen")), "left_semi")
    if chosen.filter("times > 1").head(1):
        kept = kept.dropDuplicates(["doc_id", "text"])
    return kept
