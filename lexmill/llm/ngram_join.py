"""Operator 4, n-gram Jaccard join with token-combination prefixes.

A document's tokens are its distinct word shingles (64-bit hashes). All tokens
are ordered: rare ones first, then the frequent class, each by hash. With
required overlap o, two documents that link share at least m + 1 tokens within their first
``size - o + 1 + m`` tokens. If one that stands within ``size - o + 1`` is rare, it is found by an
index of single tokens. Otherwise both have all their rare tokens there and share none, so the
m + 1 shared tokens are frequent ones. Tokens are dealt into m classes by their hash; of m + 1
shared tokens two fall into one class, so only combinations of two frequent tokens of one
class are indexed. m grows with the size (a power of two, about a third of the prefix), so a prefix of
any length gives combinations in proportion to its length, and no frequent token is ever indexed
alone: widely shared passages do not fill buckets. Candidates pass length and position
bounds and a bound from parity bitmaps (the sets differ in at least as many tokens
as the bitmaps differ in bits), then whole sets are compared.

Equal sets are one node from the start. In each bucket all members are first
compared to its least one only; members that links then tie together share a label. Of a bucket's
other pairs only those of different labels go on, and they are found from the members whose label
is not that of the least one. So a group of near copies costs about its size, not its square, and
a pair is left out only where its two documents are connected already.

Shuffled are keys, not texts, and once: buckets are runs of a sort by key. Combinations of tokens that HOT of all
documents have may be in as many documents; they are counted first (combined before the shuffle) and then joined, so that
adaptive execution can split a key that outgrows a partition. So it can in every other join here, as all
sides that are not broadcast are plain shuffles. Sets are sent only for documents of candidate
pairs. Frequent is a share of all documents, whatever their length: tasks count in a bounded sketch and report by share. The
class is bounded: its tokens are in at least 3/4 of SHARE of all documents, and there are at most MOST of them.

Null or wordless texts have empty sets and link with nothing. Rows that share a
doc_id count as one node (any of their links is the id's); a null doc_id gets a
null component. Every row gives a row; an empty table gives none; other columns
are ignored. Very long texts are hashed whole, one at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import components
from .shared import Tables, checkpoint, small_or_as_is
from .wordhash import blocks, mix, shingle_sets

WIDTH, PERCENT = 4, 85
#: A token in at least SHARE of the documents is of the frequent class, and hot if it is in HOT of them.
SHARE, HOT = 0.002, 0.01
#: Tokens that a task counts at once, counters it holds, and rows it reports at once.
WINDOW, COUNTERS, ROWS = 1 << 18, 1 << 20, 1 << 16
#: A token in fewer than LEAST documents is never frequent (its bucket is small anyway); at most MOST tokens are. Counts under FEW of small tasks are drawn.
LEAST, MOST, FEW = 8, 1 << 22, 4
#: 64-bit words of every set's coarse parity bitmap; sets over FINE tokens have a fine one too, of one or two bits a token.
MAP_WORDS, FINE = 8, 400
_PAIR = np.uint64(0xD6E8FEB86659FD93)


def _columns(part: pa.RecordBatch, first: int, last: int) -> pa.Array:
    return part.column("doc_id").slice(first, last - first).cast(pa.int64())


class Common:
    """Counts of the most common tokens of a task in bounded memory (Misra and Gries): at most ``counters`` of them, each short by
    at most ``error``, which is at most the tokens seen by ``counters``."""

    def __init__(self, counters: int = COUNTERS):
        self.counters, self.error = counters, 0
        self.tokens, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def add(self, sets: list[np.ndarray]) -> None:
        new, n = np.unique(np.concatenate(sets), return_counts=True)
        if not len(new):
            return
        n = n.astype(np.int32)
        at = np.searchsorted(self.tokens, new)
        held = np.zeros(len(new), bool)
        if len(self.tokens):
            held = self.tokens[np.minimum(at, len(self.tokens) - 1)] == new
        self.counts[at[held]] += n[held]
        self.tokens, self.counts = np.insert(self.tokens, at[~held], new[~held]), np.insert(self.counts, at[~held], n[~held])
        if (over := len(self.tokens) - self.counters) > 0:
            cut = np.partition(self.counts, over - 1)[over - 1]
            self.error += int(cut)
            kept = self.counts > cut
            self.tokens, self.counts = self.tokens[kept], self.counts[kept] - cut

    def reported(self, least: float, salt: int) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, counts) of the tokens that may be in ``least`` documents. Where that is under FEW, counts under FEW are drawn by a hash
        in proportion and count as FEW: right on average, and close for every token of many documents."""
        if least >= FEW:
            kept = self.counts + self.error >= least
            return self.tokens[kept], self.counts[kept]
        drawn = (mix(self.tokens ^ mix(np.array([salt], np.uint64))) % np.uint64(FEW)).astype(np.int64) < self.counts
        return self.tokens[drawn], np.maximum(self.counts[drawn], FEW)


def frequent_tokens(docs: DataFrame, width: int, share: float, hot: float) -> tuple[np.ndarray, np.ndarray]:
    """The frequent class, sorted, and whether each is hot. Tasks report what may be in a quarter of ``share`` of their documents; of these
    tokens those are taken whose sums reach three quarters of it. So every token of ``share`` of all documents is found, where the mean set has up to
    COUNTERS * share / 4 tokens (beyond: every one of 3/4 of share + mean / COUNTERS), and none that is in less than three quarters.
    ``share`` is raised where it would let more than MOST tokens pass: they are sent to every task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, held = Common(), []
        size = waiting = n_docs = 0
        for batch in batches:
            for _, _, offsets, raw in blocks(batch.column("text")):
                for tokens in shingle_sets(offsets, raw, width):
                    n_docs += 1
                    waiting += len(tokens)
                    held.append(tokens)
                    if waiting >= WINDOW:
                        common.add(held)
                        size, waiting, held = size + waiting, 0, []
        if held:
            common.add(held)
        tokens, counts = common.reported(share * n_docs / 4, TaskContext.get().partitionId())
        for a in range(0, len(tokens), ROWS):
            part = slice(a, a + ROWS)
            none = np.zeros(len(tokens[part]), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(tokens[part].view(np.int64)), pa.array(counts[part].astype(np.int64)), pa.array(none)], ["token", "n", "size"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([n_docs], pa.int64()), pa.array([size + waiting], pa.int64())], ["token", "n", "size"])

    counts = checkpoint(docs.select("text").mapInArrow(run, "token long, n long, size long").groupBy("token").agg(F.sum("n").alias("n"), F.sum("size").alias("size")))
    of_all = counts.where("token is null").agg(F.sum("n").alias("n"), F.sum("size").alias("size")).first()
    total, size = of_all["n"] or 0, of_all["size"] or 0
    least = max(LEAST, 0.75 * share * total, size / MOST)  # tokens in that many documents are at most size / least
    found = counts.where(F.col("token").isNotNull() & (F.col("n") >= least)).orderBy("token").toPandas()
    tokens = found["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], (found["n"].to_numpy(np.int64) >= hot * total)[order]


def _least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def classes(n: int, percent: int) -> int:
    """Into how many classes frequent tokens are dealt for pairs whose larger set has n tokens."""
    reach = n - _least_overlap(n, percent) + 1
    return 1 << max(0, (reach // 2).bit_length() - 1)


def _combined(tokens: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the earlier, of the later token) of all twos of one class."""
    kind = (tokens >> np.uint64(11)) & np.uint64(parts - 1)
    order = np.argsort(kind, kind="stable")
    kind = kind[order]
    first, second = [], []
    for step in range(1, len(tokens)):
        same = np.flatnonzero(kind[step:] == kind[:-step])
        if not len(same):
            break
        first.append(order[same])
        second.append(order[same + step])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *first]), np.concatenate([none, *second])


def prefix_keys(tokens: np.ndarray, frequent: np.ndarray, hot: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, places, whether the key may be hot) of one sorted set; no more tokens than ``size - place`` can be shared if a
    pair's first meeting is by that key."""
    n = len(tokens)
    if not n:
        return tokens, np.zeros(0, np.int64), np.zeros(0, bool)
    reach = n - _least_overlap(n, percent) + 1
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        common = frequent[at] == tokens
    else:
        common = np.zeros(n, bool)
    rare = tokens[~common]
    r = min(len(rare), reach)
    if r == reach:
        return rare[:r], np.arange(r), np.zeros(r, bool)
    often, very = tokens[common], hot[at[common]]
    # the larger set of a pair says how many classes there are: this one, or one up to 100/percent of its size
    least, most = classes(n, percent), classes(100 * n // percent, percent)
    keys, places, hots = [rare[:r]], [np.arange(r)], [np.zeros(r, bool)]
    parts = least
    while parts <= most:
        wide = often[: reach + parts - r]
        a, b = _combined(wide, parts)
        keys.append(mix(wide[a] * _PAIR + mix(wide[b])))
        # up to ``parts`` shared tokens can stand before the later one of the first two that meet
        places.append(np.maximum(0, r + b - most))
        hots.append(very[a] & very[b])
        parts *= 2
    found, at = np.unique(np.concatenate(keys), return_index=True)
    return found, np.concatenate(places)[at], np.concatenate(hots)[at]


def parity_map(tokens: np.ndarray, words: int) -> np.ndarray:
    """Bit b: whether an odd number of tokens falls on it."""
    bits = 64 * words
    parity = np.bincount((tokens >> np.uint64(20) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64)


def fine_words(size: int) -> int:
    """Words of the fine bitmap: a power of two, of one to two bits a token; none for small sets."""
    return 1 << (-(-size // 64) - 1).bit_length() if size > FINE else 0


def _lists(parts: list[np.ndarray], kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, parts)]).astype(np.int32), np.concatenate(parts).astype(kind, copy=False))


def profiles(docs: DataFrame, frequent, width: int, percent: int) -> DataFrame:
    """doc_id, size, sign1, sign2 (of the whole set), keys, places, hot_keys, hot_places, bits, fine."""
    weights = np.uint64(0x9FB21C651E98DF25)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, hot = frequent.value
        for batch in batches:
            for first, last, offsets, raw in blocks(batch.column("text")):
                sizes, signs, lists = [], ([], []), ([], [], [], [], [], [])
                for tokens in shingle_sets(offsets, raw, width):
                    sizes.append(len(tokens))
                    signs[0].append(int(tokens.sum(dtype=np.uint64).view(np.int64)))
                    signs[1].append(int(mix(tokens * weights).sum(dtype=np.uint64).view(np.int64)))
                    keys, places, very = prefix_keys(tokens, common, hot, percent)
                    keys = keys.view(np.int64)
                    fine = parity_map(tokens, w) if (w := fine_words(len(tokens))) else tokens[:0].view(np.int64)
                    for out, part in zip(lists, (keys[~very], places[~very], keys[very], places[very], parity_map(tokens, MAP_WORDS), fine), strict=True):
                        out.append(part)
                yield pa.RecordBatch.from_arrays(
                    [_columns(batch, first, last), pa.array(sizes, pa.int64()), *[pa.array(s, pa.int64()) for s in signs], *[_lists(x, t) for x, t in zip(lists, (np.int64, np.int32, np.int64, np.int32, np.int64, np.int64), strict=True)]],
                    ["doc_id", "size", "sign1", "sign2", "keys", "places", "hot_keys", "hot_places", "bits", "fine"],
                )
            pa.default_memory_pool().release_unused()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, size long, sign1 long, sign2 long, keys array<long>, places array<int>, hot_keys array<long>, hot_places array<int>, bits array<long>, fine array<long>")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, offsets, raw in blocks(batch.column("text")):
                tokens = [t.view(np.int64) for t in shingle_sets(offsets, raw, width)]
                yield pa.RecordBatch.from_arrays([_columns(batch, first, last), _lists(tokens, np.int64)], ["id", "tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "id long, tokens array<long>")


def _may_link(size: Column, place: Column, other_size: Column, other_place: Column, percent: int) -> Column:
    """Bounds on the overlap from sizes, and from the key's places."""
    rest = F.least(size - place, other_size - other_place)
    return (100 * F.least(size, other_size) >= percent * F.greatest(size, other_size)) & ((100 + percent) * rest >= percent * (size + other_size))


def _apart(x: Column, y: Column) -> Column:
    """Bits that differ."""
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, k: n + k)


def _folded(words: Column, n: Column) -> Column:
    """A parity bitmap of twice n words as one of n words."""
    return F.zip_with(F.slice(words, 1, n), F.slice(words, n + 1, n), lambda p, q: p.bitwiseXOR(q))


def _unpruned(pairs: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and bitmaps leave: sets that link differ in at most (100 - percent) / (100 + percent) of
    their sizes' sum, and so do their bitmaps. An id with several sets has no map and is left. First the small maps of all
    pairs, then the fine ones of what they leave of large sets."""
    ids = checkpoint(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    asked = maps.join(small_or_as_is(ids), "id", "left_semi")
    sided = lambda side, name, *columns: asked.select(F.col("id").alias(side), F.struct(*columns).alias(name))
    large = F.size("fine") > 0
    both = pairs.join(sided("a", "x", "size", "bits", large.alias("large")), "a").join(sided("b", "y", "size", "bits", large.alias("large")), "b")
    na, nb = F.col("x.size"), F.col("y.size")
    allowed = lambda apart: F.coalesce((100 + percent) * apart <= (100 - percent) * (na + nb), F.lit(True))
    sizes = F.coalesce(100 * F.least(na, nb) >= percent * F.greatest(na, nb), F.lit(True))
    left = checkpoint(both.where(sizes & allowed(_apart(F.col("x.bits"), F.col("y.bits")))).select("a", "b", F.coalesce(F.col("x.large") & F.col("y.large"), F.lit(False)).alias("large")))
    both = left.where("large").join(sided("a", "x", "size", "fine"), "a").join(sided("b", "y", "size", "fine"), "b")
    x, y = F.col("x.fine"), F.col("y.fine")
    apart = F.when(F.size(x) == F.size(y), _apart(x, y)).when(F.size(x) > F.size(y), _apart(_folded(x, F.size(y)), y)).otherwise(_apart(x, _folded(y, F.size(x))))
    return left.where("not large").select("a", "b").unionByName(both.where(allowed(apart)).select("a", "b"))


def _verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int, tables: Tables, name: str) -> DataFrame:
    """The pairs (a, b) whose whole sets link."""
    ids = checkpoint(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
    # rows that share an id: a node links if any of its sets does
    sets = tables.write(name, _sets(docs.join(small_or_as_is(ids), "doc_id", "left_semi"), width))
    half = pairs.join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("left")), "a")
    both = half.join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("right")), "b")
    met = F.size(F.array_intersect("left", "right"))
    fits = both.select("a", "b", met.alias("met"), (F.size("left") + F.size("right")).alias("sum")).where((100 + percent) * F.col("met") >= percent * F.col("sum"))
    links = checkpoint(fits.select("a", "b").distinct())
    tables.drop(name)
    return links


def _buckets(leads: DataFrame) -> DataFrame:
    """key, id, size, place, lead, lead_size, lead_place, more: every member of a bucket but its least; more: whether it has three or more."""
    entry = lambda keys, places: leads.select("id", "size", F.posexplode(keys).alias("k", "key"), places).select("key", "id", (F.shiftleft("size", 32) + F.col(places)[F.col("k")]).alias("packed"))
    order = Window.partitionBy("key").orderBy("id", "packed")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    plain = entry("keys", "places").select("key", "id", "packed", F.first("id").over(so_far).alias("lead"), F.first("packed").over(so_far).alias("lead_packed"), ((F.row_number().over(order) > 2) | F.lead("id").over(order).isNotNull()).alias("more"))
    hot = entry("hot_keys", "hot_places")
    shared = checkpoint(hot.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("id", "packed")).alias("least")).where("n > 1"))
    wide = hot.join(small_or_as_is(shared), "key").select("key", "id", "packed", F.col("least.id").alias("lead"), F.col("least.packed").alias("lead_packed"), (F.col("n") > 2).alias("more"))
    part = lambda c: (F.shiftright(c, 32), F.col(c).bitwiseAND(F.lit((1 << 32) - 1)))
    (size, place), (lead_size, lead_place) = part("packed"), part("lead_packed")
    return plain.unionByName(wide).where("id <> lead").select("key", "id", size.alias("size"), place.alias("place"), "lead", lead_size.alias("lead_size"), lead_place.alias("lead_place"), "more")


def ngram_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, share: float = SHARE, hot: float = HOT) -> DataFrame:
    """(doc_id, text) -> doc_id, n_shingles, component_id, one row per row."""
    spark = docs.sparkSession
    tables = Tables(spark, "ngram-join")
    docs = docs.select("doc_id", "text")
    frequent = spark.sparkContext.broadcast(frequent_tokens(docs, width, share, hot))
    profile = tables.write("profile", profiles(docs, frequent, width, percent))
    frequent.destroy()
    signs = ["sign1", "sign2", "size"]
    every = tables.write("sizes", profile.select("doc_id", *signs))
    members = every.where("size > 0 and doc_id is not null")
    # the least document of each set stands for it
    twins = checkpoint(members.groupBy(*signs).agg(F.min("doc_id").alias("id"), F.count("*").alias("n")).where("n > 1").drop("n"))
    copies = tables.write("copies", members.join(small_or_as_is(twins), signs).select("doc_id", *signs, "id"))
    others = copies.where("doc_id > id").select("doc_id", *signs)
    leads = profile.where("size > 0 and doc_id is not null").join(small_or_as_is(others), ["doc_id", *signs], "left_anti")
    same = checkpoint(copies.where("doc_id = id").groupBy("doc_id", *signs).count().where("count > 1").drop("count"))
    if same.take(1):  # rows repeated with their id
        same = small_or_as_is(same)
        once = leads.join(same, ["doc_id", *signs], "left_semi").dropDuplicates(["doc_id", *signs])
        leads = leads.join(same, ["doc_id", *signs], "left_anti").unionByName(once)
    leads = leads.withColumnRenamed("doc_id", "id")
    entries = tables.write("entries", _buckets(leads))
    # an id with several sets has no one bitmap, and no one size; nor is the set that stands for it in a bucket the only one:
    # pairs with it are left to the whole sets
    repeated = members.groupBy("doc_id").count().where("count > 1").select("doc_id")
    several = checkpoint(members.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.countDistinct(*signs).alias("n")).where("n > 1").select(F.col("doc_id").alias("id")))
    doubled = bool(several.take(1))
    maps, allowed = leads.select("id", "size", "bits", "fine"), _may_link(*[F.col(c) for c in ("size", "place", "lead_size", "lead_place")], percent)
    led = entries
    if doubled:
        none = [F.lit(None).cast(maps.schema[c].dataType).alias(c) for c in ("size", "bits", "fine")]
        maps = maps.join(small_or_as_is(several), "id", "left_anti").unionByName(several.select("id", *none).distinct())
        led = entries.join(small_or_as_is(several.select(F.col("id").alias("lead"), F.lit(True).alias("several"))), "lead", "left")
        allowed = F.col("several").isNotNull() | allowed
    pairs = checkpoint(led.where(allowed).select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct())
    links = _verified(checkpoint(_unpruned(pairs, maps, percent)), docs, width, percent, tables, "sets")
    # Two steps along the links found give most members of a group one label; members of one label are connected already.
    near = checkpoint(links.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("label")))
    label = checkpoint(near.join(near.select(F.col("id").alias("label"), F.col("label").alias("further")), "label", "left").select("id", F.coalesce("further", "label").alias("label")))
    label = small_or_as_is(label)
    named = entries.where("more").select("key", "id", "size", "place", "lead").join(label, "id", "left").join(label.select(F.col("id").alias("lead"), F.col("label").alias("lead_label")), "lead", "left")
    named = tables.write("named", named.select("key", "id", "size", "place", F.coalesce("label", "id").alias("label"), F.coalesce("lead_label", "lead").alias("lead_label")))
    tables.drop("entries")
    half = [f"bits{k}" for k in range(MAP_WORDS // 2)]
    small = maps.select("id", *[F.col("bits")[k].bitwiseXOR(F.col("bits")[k + MAP_WORDS // 2]).alias(c) for k, c in enumerate(half)])
    named = named.join(small, "id")
    # a pair of different labels has at least one member whose label is not the least one's
    strays = named.where("label <> lead_label").drop("lead_label")
    x, y = strays.alias("x"), named.alias("y")
    met = (F.col("x.key") == F.col("y.key")) & (F.col("x.label") != F.col("y.label")) & ((F.col("y.label") == F.col("y.lead_label")) | (F.col("x.id") < F.col("y.id")))
    fits = _may_link(*[F.col(f"{side}.{c}") for side in "xy" for c in ("size", "place")], percent)
    apart = sum((F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in half[1:]), F.bit_count(F.col(f"x.{half[0]}").bitwiseXOR(F.col(f"y.{half[0]}"))))
    near = F.coalesce((100 + percent) * apart <= (100 - percent) * (F.col("x.size") + F.col("y.size")), F.lit(True))
    more = checkpoint(x.join(y, met & fits & near).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).where("a < b").distinct())
    more = _verified(checkpoint(_unpruned(more, maps, percent)), docs, width, percent, tables, "more_sets")
    tables.drop("named", "profile")
    of = checkpoint(components(links.union(more)))
    # a set's component, then an id's: the least of its rows' sets
    found = copies.where("doc_id > id").select("doc_id", "id").join(small_or_as_is(of), "id", "left").select("doc_id", F.coalesce("component", "id").alias("component_id"))
    if doubled:
        again = copies.where("doc_id > id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
        found = checkpoint(components(again.union(links).union(more))).select(F.col("id").alias("doc_id"), F.col("component").alias("component_id"))
    else:
        found = found.unionByName(of.select(F.col("id").alias("doc_id"), F.col("component").alias("component_id")))
    found = checkpoint(found.distinct())
    return every.select("doc_id", F.col("size").alias("n_shingles")).join(small_or_as_is(found), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
