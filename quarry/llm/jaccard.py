"""N-gram Jaccard join by token-combination prefixes, down to connected components.

Tokens are hashes of word shingles. Documents with equal sets form one class; classes take part once.

Order. Tokens are ordered by a corpus count kept in a fixed number of hashed counters (every token of every document counts,
repeats included), in steps of half an octave, then by hash. Any common order is right; this one puts rare tokens first and
keeps widely shared phrases and passages out of prefixes.

Prefixes. A set of n tokens with at most e = n - ceil(t n) of them missing from a partner is indexed by its first e + 2 tokens.
Tokens are of two kinds: plain ones index alone, crowded ones in pairs. If n1 plain and n2 crowded tokens stand in the prefix,
n1 + max(0, n2 - 1) > e, so whichever e tokens the partner lacks, a plain token or a pair of crowded ones survives and
stands in both prefixes.

Which tokens are crowded is settled after the easy links are found. In each token's bucket the class with the fewest unshared
tokens is the hub; every class is verified against the hub that it shares most tokens with, and components are contracted. Only
classes in different components still matter to each other. A token is crowded if its bucket still has more than CROWD such
pairs for each member. Plain tokens then give pairs, CROWD for each index row at most, which are verified one by one. Classes
that meet in pairs of crowded tokens form families; a family is verified in blocks of bounded size, two at a time, as products
of 0/1 matrices, and of the links in such a step only a spanning forest leaves it. No link is lost, and no row is made for each
pair of a large group. A token that meets only classes of unlike sizes, as rare words do by chance, is not indexed at all.

Defined cases: null or empty text has an empty set and is its own component; rows with equal texts share a component; rows
that share a doc_id but not their text are documents of their own; a null doc_id is never the smallest, and a component of
only such rows has a null id; other columns are kept out of the result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut, spend, table
from quarry.llm.components import components
from quarry.llm.shingles import shingle_sets, shingles, slices

SLOT_BITS, SLOT_BLOCK, CROWD, ROUNDS, SHORT_LIST, BLOCK_TOKENS, BLOCK_ROWS, SLICE = 24, 1 << 14, 32, 2, 1_000_000, 500_000, 1000, 1 << 20


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _pack(x: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def _unpack(data: bytes, kind) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _count_slots(width: int):
    def run(batches):
        counts = np.zeros(1 << SLOT_BITS, np.uint16)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                slot, n = np.unique(_slots(shingles(part.column("text"), width)[1]), return_counts=True)
                counts[slot] = np.minimum(counts[slot] + n, 65535)  # of one task: the order needs no more
        used = [i for i in range(0, len(counts), SLOT_BLOCK) if counts[i : i + SLOT_BLOCK].any()]
        for k in range(0, len(used), 64):
            yield pa.RecordBatch.from_arrays([pa.array([i // SLOT_BLOCK for i in used[k : k + 64]], pa.int32()), pa.array([_pack(counts[i : i + SLOT_BLOCK].astype(np.uint64)) for i in used[k : k + 64]], pa.binary())], names=["block", "counts"])

    return run


def _sum_slots(last: bool):
    """Sum of the counters of a block; at last in steps of half an octave, a byte each."""

    def run(table: pa.Table) -> pa.Table:
        total = np.zeros(SLOT_BLOCK, np.uint64)
        for cell in table.column("counts"):
            total += _unpack(cell.as_py(), np.uint64)
        out = (2 * np.log2(np.maximum(total, 1))).astype(np.uint8) if last else total
        return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int32()), "counts": pa.array([_pack(out)], pa.binary())})

    return run


def token_weights(docs: DataFrame, width: int) -> np.ndarray:
    """A byte for each counter, 2**SLOT_BITS of them whatever the corpus: the larger, the more frequent."""
    form = "block int, counts binary"
    parts = docs.select("text").mapInArrow(_count_slots(width), form).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64)))
    total = parts.groupBy("block", "salt").applyInArrow(_sum_slots(False), form).groupBy("block").applyInArrow(_sum_slots(True), form)
    weights = np.zeros(1 << SLOT_BITS, np.uint8)
    for r in total.collect():
        weights[r.block * SLOT_BLOCK : (r.block + 1) * SLOT_BLOCK] = _unpack(bytes(r.counts), np.uint8)
    return weights


def missing_allowed(n: np.ndarray, percent: int) -> np.ndarray:
    """How many of n tokens a partner of the wanted similarity may lack at most."""
    return n - -(-percent * n // 100)


def _class_ids(offsets: np.ndarray, hashes: np.ndarray) -> list:
    """A 64-bit name for each set, None for the empty one."""
    import xxhash

    return [xxhash.xxh3_64_intdigest(hashes[a:b].tobytes()) - (1 << 63) if b > a else None for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _prefixes(width: int, percent: int, weights):
    least = math.ceil(percent / (100 - percent))  # smaller sets only have equal partners

    def run(batches):
        weight = weights.value
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                offsets, hashes = shingle_sets(part.column("text"), width)
                n = np.diff(offsets)
                keys, prefixes = _class_ids(offsets, hashes), []
                for i, size in enumerate(n):
                    own = hashes[offsets[i] : offsets[i + 1]]
                    if size < least:
                        prefixes.append(None)
                        continue
                    most = int(missing_allowed(size, percent)) + 2
                    order = np.argsort((weight[_slots(own)].astype(np.uint64) << np.uint64(56)) | (own >> np.uint64(8)), kind="stable")
                    prefixes.append(own[order[:most]].view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("version"), pa.array(keys, pa.int64()), pa.array(n, pa.int64()), pa.array(prefixes, pa.list_(pa.int64()))], names=["doc_id", "version", "cid", "n", "prefix"])

    return run


def _set_rows(width: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                offsets, hashes = shingle_sets(part.column("text"), width)
                sets = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(hashes.view(np.int64)))
                # rows that share the doc_id but not the text do not pass for the class
                own = pa.array([x == y.as_py() for x, y in zip(_class_ids(offsets, hashes), part.column("cid"), strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column("cid"), sets], names=["cid", "tokens"]).filter(own)

    return run


def short_list(rows: DataFrame) -> DataFrame:
    """rows (a written table of a few numbers a row) marked for broadcast up to SHORT_LIST of them, for a merge join beyond."""
    return F.broadcast(rows) if rows.count() <= SHORT_LIST else rows.hint("merge")


class Join:
    """The state of one join: classes with their prefixes, links found, labels so far.

    A pair is verified in two steps. If c of the tokens in two prefixes are equal, the sets share at most c tokens and what lies
    beyond a prefix; pairs that this rules out need no more. Of the others, the whole sets are made from the texts anew.
    """

    def __init__(self, docs: DataFrame, classes: DataFrame, width: int, percent: int):
        self.docs, self.classes, self.width, self.percent = docs, classes, width, percent
        self.edges = self.labels = None
        self.used: list[DataFrame] = []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """A written table that goes when the links made from it are in."""
        df = cut(df, name)
        self.used.append(df)
        return df

    def promising(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a written table) that their prefixes do not rule out. A short list is broadcast, so that prefixes of other classes stay where they are."""
        known = short_list(pairs)
        one = self.classes.join(known, F.col("cid") == F.col("a")).select("a", "b", F.col("n").alias("na"), F.col("prefix").alias("pa"))
        two = self.classes.join(known, F.col("cid") == F.col("b")).select("a", "b", F.col("n").alias("nb"), F.col("prefix").alias("pb"))
        beyond = F.greatest(F.col("na") - F.size("pa"), F.col("nb") - F.size("pb"))
        most = F.size(F.array_intersect("pa", "pb")) + beyond
        fits = (100 + self.percent) * most >= self.percent * (F.col("na") + F.col("nb"))
        return self.keep(one.join(two, ["a", "b"]).filter(fits).select("a", "b"), "promising")

    def sets(self, wanted: DataFrame) -> DataFrame:
        """cid and tokens of the classes wanted (cid). The list of their documents is broadcast if short, else joined by shuffling texts."""
        wanted = self.keep(wanted.join(self.classes, "cid").select(F.col("first").alias("__doc"), F.col("version").alias("__version"), "cid"), "wanted")
        same = F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("version") == F.col("__version"))
        texts = self.docs.join(short_list(wanted), same).select("cid", "text")
        sets = self.keep(texts.mapInArrow(_set_rows(self.width), "cid long, tokens array<long>"), "sets")
        # rows that share the doc_id and the text bring their class more than once
        return self.keep(sets.dropDuplicates(["cid"]), "sets") if sets.count() > wanted.count() else sets

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The links among pairs (a, b)."""
        pairs = self.promising(pairs)
        sets = self.sets(pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct())
        a, b = sets.select(F.col("cid").alias("a"), F.col("tokens").alias("ta")), sets.select(F.col("cid").alias("b"), F.col("tokens").alias("tb"))
        both = F.size(F.array_intersect("ta", "tb"))
        return pairs.join(a, "a").join(b, "b").filter(100 * both >= self.percent * (F.size("ta") + F.size("tb") - both)).select("a", "b")

    def add(self, links: DataFrame) -> int:
        """Take in links (a, b) that hold, and contract. How many there are."""
        new = cut(links, "links")
        spend(*self.used)
        self.used, n = [], new.count()
        if self.edges is not None:  # what is connected so far goes in as a star around each component
            before, edges, labels = self.edges, new.unionByName(self.labels.select(F.col("node").alias("a"), F.col("label").alias("b"))), self.labels
            self.labels = components(edges)
            spend(before, labels)
        else:
            self.labels = components(new)
        self.edges = new
        return n

    def families(self, keyed: DataFrame) -> DataFrame:
        """Links among classes that share a key (cid, two), by way of the families that keys make, block by block."""
        hubs = keyed.groupBy("two").agg(F.min("cid").alias("hub"), F.count("*").alias("k")).filter("k > 1").select("two", "hub")
        label = components(keyed.join(hubs, "two").select(F.col("hub").alias("a"), F.col("cid").alias("b")))
        self.used.append(label)
        member = self.keep(label.select(F.col("node").alias("cid"), F.col("label").alias("family")).join(self.classes.select("cid", "n"), "cid"), "family")
        blocks = member.groupBy("family").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_TOKENS), F.ceil(F.count("*") / BLOCK_ROWS)).cast("int").alias("blocks"))
        placed = member.join(blocks, "family").withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
        dealt = placed.select("cid", "family", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        dealt = dealt.select("cid", "family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        sets = self.sets(member.select("cid"))
        return dealt.join(sets, "cid").groupBy("family", "i", "j").applyInArrow(_family_links(self.percent), "a long, b long")

    def labelled(self, rows: DataFrame) -> DataFrame:
        """rows with comp, the component of cid so far."""
        if self.labels is None:
            return rows.withColumn("comp", F.col("cid"))
        return rows.join(short_list(self.labels.withColumnRenamed("node", "cid")), "cid", "left").withColumn("comp", F.coalesce("label", "cid")).drop("label")


def _family_links(percent: int):
    """Links among the sets of two blocks, as a spanning forest: every row with the first row of its component."""

    def run(block: pa.Table) -> pa.Table:
        cids = block.column("cid").to_numpy()
        lists = block.column("tokens").combine_chunks()
        n = np.diff(lists.offsets.to_numpy())
        row = np.repeat(np.arange(len(cids)), n)
        _, column, times = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
        met = times[column] > 1
        row, column = row[met], (np.cumsum(times > 1) - 1)[column[met]]
        both = np.zeros((len(cids), len(cids)), np.float32)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            a, b = np.searchsorted(column, [at, at + 4096])
            x = np.zeros((len(cids), 4096), np.float32)
            x[row[a:b], column[a:b] - at] = 1
            both += x @ x.T
        n = n.astype(np.float32)
        linked = (100 + percent) * both >= percent * (n[:, None] + n)  # exact: whole numbers below 2**24
        label = np.arange(len(cids))
        while True:
            least = np.where(linked, label, len(cids)).min(axis=1, initial=len(cids))
            least = np.minimum(least, label)
            least = np.minimum(least, least[least])
            if (least == label).all():
                break
            label = least
        moved = np.flatnonzero(label != np.arange(len(cids)))
        return pa.table({"a": cids[moved], "b": cids[label[moved]]})

    return run


def close_in_size(x, y, percent: int):
    return (100 * x >= percent * y) & (100 * y >= percent * x)


def open_buckets(rows: DataFrame, key: str) -> DataFrame:
    """key, members, cross: buckets with classes of several components, and how many pairs lie across."""
    per = rows.groupBy(key, "comp").agg(F.count("*").alias("k"))
    total = per.groupBy(key).agg(F.sum("k").alias("members"), F.sum(F.col("k").cast("double") * F.col("k")).alias("squares"))
    return total.select(key, "members", ((F.col("members").cast("double") * F.col("members") - F.col("squares")) / 2).alias("cross")).filter("cross > 0")


def prefix_length(n, percent: int):
    """Length of the prefix of a set of n tokens that is indexed."""
    return n - F.ceil(n * percent / F.lit(100)) + 2


def cross_pairs(rows: DataFrame, key: str, percent: int) -> DataFrame:
    """Pairs of classes that share a bucket, lie in different components, are close in size and share enough of their prefixes.

    rows: key, cid, n, comp and extra, how many prefix tokens of the class are not among the keys. Sets with c equal prefix tokens
    have at most c and what lies beyond one of the prefixes in common.
    """
    a = rows.select(key, F.col("cid").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"), F.col("extra").alias("xa"))
    b = rows.select(key, F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"), F.col("extra").alias("xb"))
    met = a.join(b, [a[key] == b[key], F.col("a") < F.col("b"), F.col("ca") != F.col("cb"), close_in_size(F.col("na"), F.col("nb"), percent)])
    beyond = F.greatest(F.col("na") - prefix_length(F.col("na"), percent), F.col("nb") - prefix_length(F.col("nb"), percent))
    most = F.col("c") + F.least("xa", "xb") + F.greatest(beyond, F.lit(0))
    fits = (100 + percent) * most >= percent * (F.col("na") + F.col("nb"))
    return met.groupBy("a", "b", "na", "nb", "xa", "xb").agg(F.count("*").alias("c")).filter(fits).select("a", "b")


def size_band(percent: int):
    """A number below 64 for the size of a set: sets that are close enough in size to link are in one band or in neighbouring ones."""
    width = 1.001 * math.log(100 / percent) if percent < 100 else 1.0
    return F.pmod(F.floor(F.ln("n") / width), F.lit(64)).cast("int")


def may_have_partner():
    """Whether some other class of a token's bucket may be close in size: bands has a bit for each band met, k counts the classes.

    More classes than bands: two share one, and it may be this one's. Else another must be in a band beside it.
    """
    beside = F.expr("shiftleft(1L, pmod(band + 1, 64)) | shiftleft(1L, pmod(band + 63, 64))")
    return (F.col("k") > F.bit_count("bands")) | (F.col("bands").bitwiseAND(beside) != 0)


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and class_id for each row of docs (doc_id, text)."""
    return component_rows(docs, width, percent).select("doc_id", "n_shingles", "component_id", "class_id")


def component_rows(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """What jaccard_components gives, with version (xxhash64 of the text) and comp, which names the component whatever its ids; null for empty sets."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("version"))
    weights = spark.sparkContext.broadcast(token_weights(docs, width))
    prefixes = cut(docs.mapInArrow(_prefixes(width, percent, weights), "doc_id long, version long, cid long, n long, prefix array<long>"), "prefixes")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "version")).alias("least")
    classes = prefixes.filter("cid is not null").groupBy("cid").agg(least, F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    classes = cut(classes.select("cid", F.col("least.doc_id").alias("first"), F.col("least.version").alias("version"), "n", "prefix", F.size("prefix").alias("long")), "classes")
    rows = cut(prefixes.select("doc_id", "version", "n", "cid"), "rows")
    spend(prefixes)
    tokens = classes.select("cid", size_band(percent).alias("band"), F.explode("prefix").alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("k"), F.bit_or(F.expr("shiftleft(1L, band)")).alias("bands")).filter("k > 1")
    bare = cut(tokens.join(shared.hint("merge"), "token").filter(may_have_partner()).select("cid", "token"), "bare-index")
    # partners have two prefix tokens in common at least, so a class that shares fewer with all others together has none
    met = bare.groupBy("cid").agg(F.count("*").alias("met")).filter("met > 1")
    alone = cut(met.join(classes.select("cid", "n", "long"), "cid").select("cid", "n", (F.col("long") - F.col("met")).alias("alone")), "alone")
    index = cut(bare.join(short_list(alone), "cid").select("token", "cid", "n", "alone"), "index")
    spend(bare, alone)
    join = Join(docs, classes, width, percent)
    at = index.withColumn("comp", F.col("cid"))
    for _ in range(ROUNDS):
        hubs = at.groupBy("token").agg(F.min(F.struct("alone", "cid", "n", "comp")).alias("hub"))
        near = at.join(hubs, "token").filter((F.col("comp") != F.col("hub.comp")) & close_in_size(F.col("n"), F.col("hub.n"), percent))
        votes = near.groupBy(F.col("cid").alias("b"), F.col("hub.cid").alias("a")).agg(F.count("*").alias("votes"))
        best = votes.groupBy("b").agg(F.max_by("a", F.struct("votes", "a")).alias("a"))
        tried = cut(best.select("a", "b"), "tried")
        few = 20 * join.add(join.linked(tried)) < tried.count()
        spend(tried)
        # a bucket whose classes are all connected by now is closed for good
        at = join.labelled(index.select("token", "cid", "n", "alone"))
        still = at.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("token")
        at = cut(at.join(still, "token"), "index")
        spend(index)
        index = at
        if few:
            break
    open_now = cut(open_buckets(at, "token").withColumn("crowded", F.col("cross") > CROWD * F.col("members")), "open")
    inside = at.join(open_now.select("token", "crowded"), "token")
    extra = inside.groupBy("cid").agg(F.count_if("crowded").alias("extra"))
    plain = cut(cross_pairs(inside.filter("not crowded").join(extra, "cid"), "token", percent), "pairs")
    many = inside.filter("crowded").groupBy("cid").agg(F.array_sort(F.collect_set("token")).alias("own")).filter(F.size("own") > 1)
    twos = many.select("cid", "own", F.posexplode("own").alias("i", "x")).select("cid", F.explode(F.transform(F.slice("own", F.col("i") + 2, F.size("own")), lambda y: F.xxhash64("x", y))).alias("two"))
    twos = cut(twos, "twos")
    spend(at, open_now)
    join.add(join.linked(plain).unionByName(join.families(twos)))
    spend(plain, twos)
    named = join.labelled(classes.select("cid", "first"))
    smallest = named.groupBy("comp").agg(F.min("first").alias("component_id"))
    named = cut(named.join(smallest, "comp").select(F.col("cid").alias("class_id"), "component_id", "comp"), "named")
    spend(classes, join.edges, join.labels)
    out = rows.join(named.hint("merge"), F.col("cid") == F.col("class_id"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "class_id", "version", "comp")


def op2_jaccard_join(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"), width=3, percent=90)
