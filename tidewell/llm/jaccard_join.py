"""Exact Jaccard self-join of word-shingle sets by a size-aware heavy-light join.

Equal sets are one class, and everything below works on classes. Two sets link when their intersection is at least
``num / den`` of their union.

* Small sets: all subsets of every size that an overlap with a partner may have are enumerated as join keys. Of the sets under one
  key the smallest is the hub: if two of them link by that key's overlap, both link to the hub, so a row per set and key
  suffices, however many sets share a key.
* Large sets: inverted lists over each set's first shingles in a global order (rare ones by hash, then frequent ones). As the
  overlap is at least ``num / den`` of either size, linked sets meet in some list. In a long list the sets' parity bits are compared first, in blocks; those
  that may link with another get their whole sets there and are scanned, in blocks, for exact overlaps; only a forest of links leaves a task, so no list makes a
  row for each of its pairs, and sets that merely share frequent shingles are moved as bits. Short lists give
  pairs: those that meet at one of their FIRST shingles, as far as their parity bits (a lower bound of the difference) allow
  a link, and those that meet later only, if they share SHARED entries and leave enough behind the last of them. The exact
  overlap decides all of these.
* The boundary: the size at which the number of subset keys, summed over the sizes as they occur, starts to cost more
  than list entries and their scans do. Sets just below it, whose partners may be above, are in both parts.

Which shingles count as frequent affects the cost only; they are found by mergeable counts over all rows, of which a bounded
number is kept.

Edge cases: a null or empty text has no shingles and links with nothing; fewer words than a shingle's are one shingle; equal
sets link; rows that repeat an id stand for one document and share its component; a null id links with nothing and has a null
component; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .scratch import discard, ship, stored, table
from .spread import hash_filter, looked_up, passes
from .textbytes import secret, shingle_sets

#: Leading shingles at which most linked sets meet.
FIRST = 4
#: Words of 64 parity bits of a set.
PARITIES = 16
#: Sets of more shingles than WIDE have WIDER words of parity bits besides, as the fewer ones are too coarse for these.
WIDE, WIDER = 1500, 128
#: Lists longer than this get whole sets for all their entries, as comparing their pairs one by one would grow with the square.
HOT = 128
#: List entries that a pair must share: each set has so many entries, less one, beyond those that make linked sets meet.
SHARED = 3
#: Sizes for which subsets may be enumerated.
MOST_SMALL = 29
#: Cost of an entry of a list against that of a subset key: it is counted, moved again, and scanned.
ENTRY_COST = 6
#: Frequent shingles known at most, and those that one task reports.
FREQUENT, REPORTED = 1 << 18, 1 << 15
#: Shingles in a block of a list.
BLOCK_SHINGLES = 400_000
#: Sets in a block of a list whose parities are compared.
BLOCK_SETS = 2048
#: Sets of a long list that may link with so many others of a block at most are told as pairs, each compared once whatever the lists it is in.
FEW = 8
#: Bytes of text handled at once.
LOT = 4_000_000


def least_overlap(n: int, num: int, den: int) -> int:
    """The least overlap of a set of ``n`` with a partner."""
    return -(-num * n // den)


def _lots(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + LOT, "right")))
        yield batch.slice(i, j - i)
        i = j


def _common(width: int, base: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for lot in _lots(batch):
                sets = list(shingle_sets(lot.column(1), width, base))
                t, c = np.unique(np.concatenate(sets) if sets else tokens[:0], return_counts=True)
                t, c = t[c > 1], c[c > 1]
                both, back = np.unique(np.concatenate([tokens, t]), return_inverse=True)
                counts = np.bincount(back, np.concatenate([counts, c]), len(both)).astype(np.int64)
                keep = np.argsort(-counts, kind="stable")[: 4 * REPORTED]
                tokens, counts = both[keep], counts[keep]
        keep = np.argsort(-counts, kind="stable")[:REPORTED]
        yield pa.record_batch([pa.array(tokens[keep].view(np.int64)), pa.array(counts[keep])], ["token", "n"])

    return run


def _ordered(s: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The set in the global order: others by hash, then the frequent ones by hash."""
    if not len(frequent):
        return s
    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
    hot = frequent[at] == s
    return np.concatenate([s[~hot], s[hot]])


def _parity(s: np.ndarray, words: int = PARITIES) -> np.ndarray:
    """Whether an odd number of the set falls into each bucket. Two sets differ in as many shingles at least as these in bits."""
    odd = np.bincount((s & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _mark(shingles: bytes) -> bytes | None:
    return hashlib.blake2b(shingles, digest_size=16).digest() if shingles else None


def _profiles(width: int, base: int, num: int, den: int, frequent: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lot in _lots(batch):
                n, mark, lead, small, parity, wider = [], [], [], [], [], []
                for s in shingle_sets(lot.column(1), width, base):
                    n.append(len(s))
                    mark.append(_mark(s.tobytes()))
                    lead.append(_ordered(s, frequent)[: len(s) - least_overlap(len(s), num, den) + SHARED].view(np.int64))
                    parity.append(_parity(s))
                    wider.append(_parity(s, WIDER).tobytes() if len(s) > WIDE else None)
                    small.append(s.view(np.int64) if 0 < len(s) <= MOST_SMALL else None)
                yield pa.record_batch([lot.column(0), pa.array(n, pa.int32()), pa.array(mark, pa.binary()), pa.array(lead, pa.list_(pa.int64())), pa.array(small, pa.list_(pa.int64())), pa.array(parity, pa.list_(pa.int64())), pa.array(wider, pa.binary())], ["id", "n", "mark", "lead", "small", "parity", "wider"])

    return run


def _flagged(width: int, base: int, bits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            batch = batch.filter(pa.array(passes(ids, bits)))
            for lot in _lots(batch):
                sets = [s.tobytes() for s in shingle_sets(lot.column(1), width, base)]
                yield pa.record_batch([lot.column(0), pa.array(map(_mark, sets), pa.binary()), pa.array(sets, pa.binary())], ["id", "mark", "shingles"])

    return run


def _subset_keys(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n, key, size = [], [], [], []
            for i, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a = np.array(s, np.int64)
                for overlap in range(least_overlap(len(s), num, den), len(s) + 1):
                    for left_out in combinations(range(len(s)), len(s) - overlap):
                        ids.append(i)
                        n.append(len(s))
                        size.append(overlap)
                        key.append(hashlib.blake2b(np.delete(a, left_out).tobytes(), digest_size=16).digest())
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(n, pa.int32()), pa.array(size, pa.int32()), pa.array(key, pa.binary())], ["id", "n", "overlap", "key"])

    return run


def boundary(sizes: dict[int, int], num: int, den: int) -> int:
    """The largest size whose sets are matched by subsets."""

    def keys(s: int) -> int:
        return sum(comb(s, o) for o in range(least_overlap(s, num, den), s + 1))

    def entries(s: int) -> int:
        return ENTRY_COST * (s - least_overlap(s, num, den) + 1)

    def cost(x: int) -> int:
        return sum(c * keys(s) for s, c in sizes.items() if s <= x) + sum(c * entries(s) for s, c in sizes.items() if s >= least_overlap(x + 1, num, den))

    return min(range(MOST_SMALL + 1), key=cost)


def _scan(num: int, den: int):
    """Links within a block of a list: the shingles' own lists are scanned for a set's exact overlaps with all others.

    A set that has been scanned has been compared with all. So the sets that need no scan are those of the largest component found so
    far, which are linked whatever their pairs are, or else those of one family, which are compared in its own list. A block of
    near copies of one text is done after a few scans.
    """

    def run(block: pa.Table) -> pa.Table:
        token = block.column("token")[0].as_py()
        ids, family, h = (block.column(c).to_numpy() for c in ("id", "family", "h"))
        _, one = np.unique(np.stack([ids, h]), axis=1, return_index=True)
        sets = [np.frombuffer(block.column("shingles")[int(k)].as_buffer(), np.uint64) for k in one]
        ids, family = ids[one], family[one]
        n = np.array(list(map(len, sets)), np.int64)
        m = len(n)
        out: list[tuple[int, int]] = []
        groups, of, members = np.unique(family, return_inverse=True, return_counts=True)
        members = np.where(groups == token, 0, members)  # only here do these meet first
        known = of == int(members.argmax()) if members.max(initial=0) > 1 else np.zeros(m, bool)
        by_family = 2 * known.sum() >= m
        if m > 1 and not known.all():
            flat = np.concatenate(sets)
            owner = np.repeat(np.arange(m), n)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
            length = np.diff(np.append(first, len(flat)))
            shared = length > 1
            lists = np.repeat(np.arange(len(first)), length)
            keep = shared[lists]
            of_set = lists[keep][np.argsort(owner[keep], kind="stable")]
            at = np.concatenate([[0], np.cumsum(np.bincount(owner[keep], minlength=m))])
            component, size = np.arange(m), np.ones(m, np.int64)
            big = -1  # the largest component, once it holds more than one set

            todo = np.argsort(np.abs(n - np.median(n)), kind="stable")  # sets of middling size link with most
            todo = todo[~known[todo]] if by_family else todo
            while len(todo):
                later = []
                for a in todo.tolist():
                    if not by_family and component[a] == big:
                        later.append(a)
                        continue
                    mine = of_set[at[a] : at[a + 1]]
                    if not len(mine):
                        continue
                    lengths = length[mine]
                    ends = np.cumsum(lengths)
                    met = owner[np.repeat(first[mine] - (ends - lengths), lengths) + np.arange(ends[-1])]
                    overlap = np.bincount(met, minlength=m)
                    linked = np.flatnonzero(den * overlap >= num * (n[a] + n - overlap))
                    own, fresh = component[linked], component[a]
                    for c in np.unique(own[own != fresh]).tolist():
                        b = int(linked[np.flatnonzero(own == c)[0]])
                        out.append((int(ids[a]), int(ids[b])))
                        component[component == c] = fresh
                        size[fresh] += size[c]
                    if size[fresh] > 1 and (big < 0 or component[big] != big or size[fresh] > size[big]):
                        big = int(fresh)
                todo = np.array([a for a in later if component[a] != big], np.int64)
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})

    return run


def _may_link(num: int, den: int):
    """The sets of a block of a list that more than FEW others are near enough to, by size and by parity bits; of the rest, the pairs."""

    def run(block: pa.Table) -> pa.Table:
        n = block.column("n").to_numpy().astype(np.int64)
        order = np.argsort(n, kind="stable")
        n = n[order]
        bits = np.stack([block.column(f"p{k}").to_numpy() for k in range(PARITIES)])[:, order].view(np.uint64)
        upto = np.searchsorted(n, den * n // num, "right")  # beyond, sets are too large for this one
        x, y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        wider = block.column("wider").take(pa.array(order))
        held = np.flatnonzero(wider.is_valid().to_numpy())
        row = np.full(len(n), -1)
        row[held] = np.arange(len(held))
        more = np.frombuffer(b"".join(wider.drop_null().to_pylist()), np.uint64).reshape(len(held), WIDER)
        for a in range(len(n)):
            later = slice(a + 1, int(upto[a]))
            apart = np.bitwise_count(bits[:, later] ^ bits[:, a, None]).sum(0, dtype=np.int64)
            both = n[later] + n[a]
            most = both - 2 * -(-num * both // (num + den))
            met = apart <= most
            if row[a] >= 0:
                again = np.flatnonzero(met)  # the later ones are larger
                met[again] = np.bitwise_count(more[row[a + 1 + again]] ^ more[row[a]]).sum(1, dtype=np.int64) <= most[again]
            y.append(a + 1 + np.flatnonzero(met))
            x.append(np.full(len(y[-1]), a))
        x, y = np.concatenate(x), np.concatenate(y)
        others = np.bincount(x, minlength=len(n)) + np.bincount(y, minlength=len(n))
        few = np.minimum(others[x], others[y]) <= FEW
        ids, h = (block.column(c).to_numpy()[order] for c in ("id", "h"))
        live, x, y = np.flatnonzero(others > FEW), x[few], y[few]
        a = np.concatenate([live, x])
        only = np.arange(len(a)) < len(live)
        b = np.concatenate([live, y])
        return pa.table({"token": pa.array(np.full(len(a), block.column("token")[0].as_py())), "id": ids[a], "h": h[a], "b": pa.array(ids[b], mask=only), "hb": pa.array(h[b], mask=only)})

    return run


def _compared(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for i, j, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                s, t = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                overlap = len(np.intersect1d(s, t, assume_unique=True))
                if den * overlap >= num * (len(s) + len(t) - overlap):
                    a.append(i)
                    b.append(j)
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _in_blocks(rows: DataFrame, chunks) -> DataFrame:
    """Each row once for every pair of blocks (ca, cb) of its list that its own block, ``chunk``, is in."""
    rows = rows.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(1)), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks").cast("int") - 1))
    return rows.withColumn("other", other).withColumn("ca", F.least("chunk", "other")).withColumn("cb", F.greatest("chunk", "other")).drop("other", "chunks")


def set_links(docs: DataFrame, width: int, num: int, den: int, base: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Profiles (id, n, least) of the rows, where ``least`` is the smallest id of an equal set; links (a, b) between those; tables both read."""
    rows = docs.where("id is not null").select("id", "text")
    top = rows.mapInArrow(_common(width, base), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where("n > 7").orderBy(F.desc("n"), "token").limit(FREQUENT)
    frequent = np.sort(np.array([r.token for r in top.select("token").collect()], np.int64).view(np.uint64))
    found = stored(docs.mapInArrow(_profiles(width, base, num, den, frequent), "id long, n int, mark binary, lead array<long>, small array<long>, parity array<long>, wider binary"), "profiles")
    # Equal sets are reduced within each task before they move: a class's row is that of its least id.
    known = found.where("mark is not null and id is not null")
    whole = known.groupBy("mark").agg(F.min_by(F.struct("id", "n", "lead", "small", "parity", "wider"), "id").alias("s"), F.count("*").alias("copies"))
    whole = stored(whole.select("mark", "copies", "s.*"), "sets")
    sets = whole.withColumn("h", F.xxhash64("mark")).drop("mark", "copies")  # with the id it names a set: rows that repeat an id may differ
    classes = whole.select("mark", F.col("id").alias("least"), "copies")

    sizes = {r.n: r.c for r in sets.where(F.col("n") <= 2 * MOST_SMALL).groupBy("n").agg(F.count("*").alias("c")).collect()}
    most = boundary(sizes, num, den)
    keys = sets.where(F.col("n") <= most).select("id", "small").mapInArrow(_subset_keys(num, den), "id long, n int, overlap int, key binary")
    hubs = keys.groupBy("key", "overlap").agg(F.min(F.struct("n", "id")).alias("hub"), F.count("*").alias("m")).where("m > 1")
    by_subset = keys.join(hubs, ["key", "overlap"]).where(f"id <> hub.id and {den} * overlap >= {num} * (n + hub.n - overlap)").select(F.col("id").alias("a"), F.col("hub.id").alias("b"))

    large = sets.where(F.col("n") >= least_overlap(most + 1, num, den))
    entries = large.select("id", "h", "n", F.posexplode("lead").alias("pos", "token"))
    lists = entries.groupBy("token").agg(F.count("*").alias("m")).where("m > 1")
    met = stored(entries.join(lists, "token"), "lists")
    # Pairs that meet in the short lists of the first shingles, once each, as far as their parities allow a link.
    pair = [F.col("x.id").alias("a"), F.col("x.h").alias("ha"), F.col("y.id").alias("b"), F.col("y.h").alias("hb")]
    need = f"ceil({num} * (na + nb) / {num + den})"
    fits = f"x.id < y.id and least(x.n, y.n) * {den} >= greatest(x.n, y.n) * {num}"
    apart = " + ".join(f"bit_count(x.p{k} ^ y.p{k})" for k in range(PARITIES))
    marks = large.select("id", "h", F.slice("lead", 1, FIRST).alias("first"), *[F.col("parity")[k].alias(f"p{k}") for k in range(PARITIES)])
    early = met.where((F.col("pos") < FIRST) & (F.col("m") <= HOT)).select("token", "id", "h", "n").join(marks, ["id", "h"])
    meeting = (
        early.alias("x")
        .join(early.alias("y"), "token")
        .where(f"{fits} and {apart} <= x.n + y.n - 2 * ceil({num} * (x.n + y.n) / {num + den}) and array_min(array_intersect(x.first, y.first)) = token")
        .select(*pair)
    )
    # Pairs that share no first shingle: they must share enough others.
    later = met.where(F.col("m") <= HOT).join(large.select("id", "h", F.slice("lead", 1, FIRST).alias("first")), ["id", "h"]).select("token", "id", "h", "n", "pos", "first")
    rest = (
        later.alias("x")
        .join(later.alias("y"), "token")
        .where(f"{fits} and not arrays_overlap(x.first, y.first)")
        .groupBy(*pair, F.col("x.n").alias("na"), F.col("y.n").alias("nb"))
        .agg(F.count("*").alias("c"), F.max("x.pos").alias("pa"), F.max("y.pos").alias("pb"))
        .where(f"c >= least({SHARED}, {need}) and c + least(na - pa, nb - pb) - 1 >= {need}")  # what is left behind the last of them
    )
    bits = marks.drop("first")
    rest = rest.join(bits.withColumnsRenamed({"id": "a", "h": "ha"}).alias("x"), ["a", "ha"]).join(bits.withColumnsRenamed({"id": "b", "h": "hb"}).alias("y"), ["b", "hb"]).where(f"{apart} <= na + nb - 2 * {need}").select("a", "ha", "b", "hb")
    met_once = stored(meeting.union(rest), "pairs")

    # A set's family is its first shingle, if that one's list is long too: pairs of a family meet there. In a short list they might not be paired, as the
    # least of their common first shingles may have a long one.
    families = met.where((F.col("pos") == 0) & (F.col("m") > HOT)).select("id", "h", F.col("token").alias("family"))
    hot = met.where(F.col("m") > HOT).select("token", "id", "h", "n").join(families, ["id", "h"], "left").withColumn("family", F.coalesce("family", "token"))
    hot_lists = hot.groupBy("token").agg(F.count("*").alias("m"), F.min("family").alias("one"), F.max("family").alias("last"))
    hot_lists = hot_lists.where("one <> last or one = token").drop("one", "last")  # else all have met in the list of their first
    # Only sets that may link with another of the list, by the parities, get their whole sets there.
    asked = hot.join(hot_lists.select("token", "m"), "token").select("token", "id", "h", "n", "m").join(large.select("id", "h", *[F.col("parity")[k].alias(f"p{k}") for k in range(PARITIES)], "wider"), ["id", "h"])
    live = _in_blocks(asked, F.ceil(F.col("m") / BLOCK_SETS)).groupBy("token", "ca", "cb").applyInArrow(_may_link(num, den), "token long, id long, h long, b long, hb long")
    live = stored(live.distinct(), "live")
    few = live.where("id <> b").select(F.least(F.struct("id", "h"), F.struct(F.col("b").alias("id"), F.col("hb").alias("h"))).alias("x"), F.greatest(F.struct("id", "h"), F.struct(F.col("b").alias("id"), F.col("hb").alias("h"))).alias("y"))
    pairs = met_once.union(few.select("x.id", "x.h", "y.id", "y.h")).distinct()
    near = stored(hot.join(hot_lists.select("token"), "token", "left_semi").join(live.where("b is null"), ["token", "id", "h"], "left_semi"), "near")
    held_by = near.groupBy("token").agg(F.sum("n").alias("shingles"))
    wanted = stored(near.select("id", "h").union(pairs.select("a", "ha")).union(pairs.select("b", "hb")).distinct(), "wanted")
    held = stored(rows.mapInArrow(_flagged(width, base, hash_filter(wanted.select("id"), wanted.count())), "id long, mark binary, shingles binary").select("id", F.xxhash64("mark").alias("h"), "shingles").join(wanted, ["id", "h"], "left_semi").dropDuplicates(["id", "h"]), "held")
    blocks = _in_blocks(near.join(held_by, "token").select("token", "id", "h", "family", "shingles"), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).drop("shingles").join(held, ["id", "h"])
    scanned = blocks.groupBy("token", "ca", "cb").applyInArrow(_scan(num, den), "a long, b long")
    one = pairs.join(held.withColumnsRenamed({"id": "a", "h": "ha", "shingles": "s"}), ["a", "ha"]).join(held.withColumnsRenamed({"id": "b", "h": "hb", "shingles": "t"}), ["b", "hb"])
    compared = one.select("a", "b", "s", "t").mapInArrow(_compared(num, den), "a long, b long")
    told = looked_up(found.select("id", "n", F.when(F.col("id").isNotNull(), F.col("mark")).alias("mark")), classes, ["mark"], "copies", found.count())
    return told.select("id", "n", "least"), by_subset.union(scanned).union(compared), [found, whole, met, met_once, live, near, wanted, held]


def jaccard_components(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", base: int | None = None) -> DataFrame:
    """A row for each row of ``docs``: the id, n_shingles, component_id (the smallest id that links reach, itself included).

    ``base`` is that of the words' hashes; each call has a secret one of its own unless it is given.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    profiles, links, read = set_links(rows, width, num, den, base or secret())
    profiles = stored(profiles, "classes")
    same = profiles.where("least is not null").groupBy("id").agg(F.min("least").alias("first"), F.max("least").alias("last")).where("first <> last")
    repeated = profiles.join(same, "id").select(F.col("least").alias("a"), F.col("first").alias("b"))
    found = components(links.union(repeated))
    discard(*read)
    return profiles.join(found, F.col("least") == F.col("node"), "left").select(
        F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "least", "id")).alias("component_id")
    )


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), width=3, num=90, den=100)


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda k: array_to_string(words[k : k + 2], ' '))) END AS shingles
  FROM w
), flat AS MATERIALIZED (SELECT doc_id, len(shingles) AS n, hash(unnest(shingles)) AS h FROM s),
common AS MATERIALIZED (
  SELECT x.doc_id AS a, y.doc_id AS b FROM flat AS x JOIN flat AS y ON x.h = y.h AND x.doc_id < y.doc_id
  WHERE 100 * least(x.n, y.n) >= 90 * greatest(x.n, y.n)
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))
), links AS MATERIALIZED (SELECT a, b FROM common UNION ALL SELECT b, a FROM common),
reach AS (
  SELECT doc_id, doc_id AS to_id FROM documents
  UNION SELECT r.doc_id, l.b FROM reach AS r JOIN links AS l ON r.to_id = l.a
)
SELECT s.doc_id, len(shingles) AS n_shingles, m.component_id
FROM s JOIN (SELECT doc_id, min(to_id) AS component_id FROM reach GROUP BY doc_id) AS m ON s.doc_id = m.doc_id
"""
