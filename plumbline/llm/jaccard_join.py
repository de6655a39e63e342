"""Exact Jaccard join of documents on word shingles: a grouped prefix join, and the components of its links.

Two sets whose Jaccard similarity reaches the threshold share a member among the first ``n - ceil(t n) + 1`` of each, in
any order that is the same for all sets (prefix filter).  The order used here puts shingles that few documents hold
first: counts of hashed shingles over all documents give each shingle a class, and a set is ordered by class and hash.
Documents with the same set are one unit, and units with the same prefix and size one group; candidates are pairs of
groups that share a prefix shingle and pass the length and position filters.  Group pairs are expanded to pairs of units,
which are verified on the whole sets.

Links only matter for the components, so candidates come in two rounds.  In the first, each of a shingle's groups is
paired with three of them alone: the smallest, the next smaller one and the one that shares most.  That joins near copies,
however many, in a number of pairs in proportion to their number.  In the last, the groups that are still in different
components are paired, filtered as groups, and only then expanded to their members.  No pair between components is left
out, so the components are those of all links.

Each set carries the parities of its members by hash bucket.  Buckets of unlike parity are a lower bound of how many
members two sets do not share, so that pairs are dropped within the joins that would make them, which loses no link.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from . import common
from .shingling import shingle_set

#: log2 of the number of counters for shingles: as many counters as documents, within these bounds (4 MB of classes at most).
SKETCH_BITS, MOST_SKETCH_BITS = 18, 22
#: Buckets of the bound on what two sets do not share, one bit each; 64-bit words of them, and of their fold in the join of
#: groups, whose generated code has to stay small enough to be compiled.
PARITIES = 2048
WORDS, FOLDED = PARITIES // 64, 8
#: A shingle that more documents hold than this is dealt to several tasks in the first round.
SPLIT = 200_000


def sketch_bits(docs: DataFrame) -> int:
    return max(SKETCH_BITS, min(MOST_SKETCH_BITS, docs.count().bit_length()))


def shingle_classes(docs: DataFrame, text_col: str, k: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of all documents' shingles by hash bucket, and the buckets' classes: 0 for those with counts to be expected
    by chance, then a class for each doubling.  One row of counts a bucket, whatever the corpus."""

    def run(batches):
        counts = np.zeros(1 << bits, dtype=np.int64)
        held: list[np.ndarray] = []
        n = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append((shingle_set(text, k) >> np.uint64(64 - bits)).astype(np.int64))
                n += len(held[-1])
                if n >= 1 << bits:
                    counts += np.bincount(np.concatenate(held), minlength=1 << bits)
                    held, n = [], 0
        if held:
            counts += np.bincount(np.concatenate(held), minlength=1 << bits)
        used = np.flatnonzero(counts)
        for at in range(0, len(used), 1 << 18):
            some = used[at : at + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], names=["bucket", "n"])

    rows = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    got = rows.toArrow()  # at most 2 ** bits rows
    counts = np.zeros(1 << bits, dtype=np.int64)
    counts[got["bucket"].to_numpy()] = got["n"].to_numpy()
    usual = float(np.median(counts))
    excess = counts - usual - 6 * np.sqrt(usual + 1)
    return counts, np.where(excess > 0, 1 + np.log2(np.maximum(excess, 1)).astype(np.int64), 0).astype(np.uint8)


def parities(found: np.ndarray) -> np.ndarray:
    """Whether an odd number of a set's members falls in each of PARITIES hash buckets, as 64-bit words."""
    odd = np.bincount(((found >> np.uint64(8)) % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str, k: int, share: tuple[int, int]) -> DataFrame:
    """doc_id, n, fp (of the set), gid (of prefix and size), parity (of members by hash bucket), prefix, salts.

    prefix is empty but in the first row of a group within a task, so that copies cost nothing further.  salts has the
    task that a prefix shingle's group is dealt to, or -1 where the shingle is not dealt to several.
    """
    num, den = share
    bits = sketch_bits(docs)
    counts, classes = shingle_classes(docs, text_col, k, bits)
    shared = docs.sparkSession.sparkContext.broadcast((np.maximum(1, counts // SPLIT).astype(np.int32), classes))
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        split, ranks = shared.value
        seen: set[int] = set()
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                found = shingle_set(text, k)
                n = len(found)
                if not n:
                    rows.append((0, b"", 0, None, [], []))
                    continue
                bucket = (found >> np.uint64(64 - bits)).astype(np.int64)
                first = n - -(-num * n // den) + 1
                # found is sorted, so a stable sort by class alone orders by class and hash
                order = np.argsort(ranks[bucket], kind="stable")[:first]
                prefix = found[order].view(np.int64)
                gid = xxhash.xxh3_64_intdigest(prefix.tobytes(), n & 0xFFFFFFFF)
                new = gid not in seen
                seen.add(gid)
                rows.append((n, xxhash.xxh3_128_digest(found.tobytes()), gid - (1 << 64) if gid >> 63 else gid, parities(found), prefix if new else [], np.where(split[bucket[order]] > 1, (gid >> 2) % split[bucket[order]].astype(np.int64), -1) if new else []))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            types = [pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(cols, types, strict=True))], names=["doc_id", "n", "fp", "gid", "parity", "prefix", "salts"])

    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, n long, fp binary, gid long, parity array<long>, prefix array<long>, salts array<long>")


def passes(n1, n2, p1, p2, share: tuple[int, int]):
    """Length and position filters for sets of n1 and n2 members that share the members at p1 and p2 of their orders."""
    num, den = share
    most = F.least(n1 - p1, n2 - p2)
    return (F.least(n1, n2) * den >= F.greatest(n1, n2) * num) & (most * (num + den) >= (n1 + n2) * num)


def may_link(a: str, b: str, share: tuple[int, int], words: int = WORDS):
    """Whether sets of aliases a and b, by size and parities (words p0, p1, ...), can have enough members in common."""
    num, den = share
    unlike = " + ".join(f"bit_count({a}.p{i} ^ {b}.p{i})" for i in range(words))
    return F.expr(f"({a}.n + {b}.n - ({unlike})) * {num + den} >= ({a}.n + {b}.n) * {2 * num}")


def components(links: DataFrame) -> DataFrame:
    """vertex, root of every vertex of the links (a, b): vertices of a component have one root.

    Each round sends every vertex to its smallest neighbour and contracts the links.  Vertices are fingerprints here, so
    their order is random and rounds grow with the logarithm of a component's size; a long chain whose vertices lie in
    order would shrink by one a round.  Each round is written to the shared folder.
    """
    links = common.stored(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    roots = None
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        step = common.stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")))
        step = common.small_side(step, 128)  # sent to all tasks if its counted rows are few, else shuffled
        if roots is None:
            roots = step.select(F.col("u").alias("vertex"), F.col("m").alias("root"))
        else:
            roots = common.stored(roots.join(step, roots["root"] == step["u"], "left").select("vertex", F.coalesce("m", "root").alias("root")))
        to_a, to_b = step.select(F.col("u").alias("a"), F.col("m").alias("ma")), step.select(F.col("u").alias("b"), F.col("m").alias("mb"))
        moved = links.join(to_a, "a").join(to_b, "b").where("ma <> mb")
        links = common.stored(moved.select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b")).distinct())
    return roots if roots is not None else links.select(F.col("a").alias("vertex"), F.col("b").alias("root"))


class Join:
    """One run of the join over docs; see link()."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, k: int, share: tuple[int, int]):
        common.small_batches(docs.sparkSession)
        self.docs, self.id_col, self.text_col, self.k, self.share = docs, id_col, text_col, k, share
        self.signed = common.stored(signatures(docs, id_col, text_col, k, share))
        some = self.signed.where("n > 0")
        self.units = common.stored(some.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.min("gid").alias("gid"), F.min("n").alias("n")))

    def shared_postings(self) -> DataFrame:
        """token, gid, n, pos of prefix shingles that two groups or more share, with the smallest group (pivot), the next
        smaller one (prev) and how many there are (groups), in each of the tasks that a shingle is dealt to."""
        exploded = self.signed.where("size(prefix) > 0").select("gid", "n", F.posexplode(F.arrays_zip("prefix", "salts")).alias("pos", "x"))
        postings = exploded.select(F.col("x.prefix").alias("token"), F.col("x.salts").alias("salt"), "gid", "n", F.col("pos").cast("long").alias("pos"))
        order = Window.partitionBy("token", "salt").orderBy("n", "gid")
        this = F.struct("gid", "n", "pos")
        near = postings.select("*", F.first(this).over(order).alias("pivot"), F.lag(this).over(order).alias("prev"), F.lead("gid").over(order).alias("next"), F.count("*").over(Window.partitionBy("token", "salt")).alias("groups"))
        # a group of a token dealt to several tasks may be alone in any of them, the first too, and is kept
        return common.stored(near.where("gid <> pivot.gid or next <> gid or salt >= 0").drop("next", "salt"))

    def parity_of(self, wanted: DataFrame) -> DataFrame:
        """fp, n and parities of the sets whose fp is wanted; a column a word, which joins compare fastest."""
        rows = self.signed.where("n > 0").select("fp", "n", *[F.col("parity")[i].alias(f"p{i}") for i in range(WORDS)])
        return common.stored(rows.join(common.small_side(wanted, 64), "fp", "left_semi").dropDuplicates(["fp"]))

    def possible(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose sets can have enough members in common, by their parities."""
        wanted = common.stored(pairs.select(F.col("a").alias("fp")).union(pairs.select(F.col("b").alias("fp"))).distinct())
        sets = self.parity_of(wanted)
        both = pairs.alias("p").join(sets.alias("x"), F.col("p.a") == F.col("x.fp")).join(sets.alias("y"), F.col("p.b") == F.col("y.fp"))
        return both.where(may_link("x", "y", self.share)).select("p.a", "p.b")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of sets, by fp, whose similarity reaches the threshold.  pairs: written, and possible().

        A set goes to its pairs as the text it comes from, compressed, which takes a third of the room of its members.
        """
        num, den = self.share
        wanted = pairs.select(F.col("a").alias("fp")).union(pairs.select(F.col("b").alias("fp"))).distinct()
        ids = common.stored(self.units.join(wanted, "fp", "left_semi").select(F.col("rep").alias("__rep")).distinct())
        docs = self.docs.select(F.col(self.id_col).alias("doc_id"), F.col(self.text_col).cast("string").alias("text"))
        docs = docs.join(common.small_side(ids, 64), F.col("doc_id").eqNullSafe(F.col("__rep")), "left_semi")
        k = self.k

        def pack(batches):
            for batch in batches:
                texts = [text or "" for text in batch.column(1).to_pylist()]
                fps = [xxhash.xxh3_128_digest(shingle_set(text, k).tobytes()) for text in texts]
                yield pa.RecordBatch.from_arrays([pa.array(fps, pa.binary()), pa.array([zlib.compress(text.encode(), 1) for text in texts], pa.binary())], names=["fp", "packed"])

        def run(batches):
            last, members = None, np.empty(0, np.uint64)
            for batch in batches:
                keep = []
                for i, (b, pa_, pb) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True)):
                    if b != last:  # the join sorts by b, so that most sets are made once a task
                        last, members = b, shingle_set(zlib.decompress(pb).decode(), k)
                    other = shingle_set(zlib.decompress(pa_).decode(), k)
                    same = len(np.intersect1d(other, members, assume_unique=True))
                    if same * (num + den) >= (len(other) + len(members)) * num:
                        keep.append(i)
                yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

        sets = common.stored(docs.mapInArrow(pack, "fp binary, packed binary"))
        both = pairs.join(sets.select(F.col("fp").alias("a"), F.col("packed").alias("pa")), "a").join(sets.select(F.col("fp").alias("b"), F.col("packed").alias("pb")), "b")
        return common.stored(both.select("a", "b", "pa", "pb").mapInArrow(run, "a binary, b binary"))

    def hubs(self, shared: DataFrame) -> DataFrame:
        """g1, g2: each shingle's groups with its most connected group.

        The original of many near copies shares its whole prefix with them, while each copy's begins with what is its own;
        so the original has the most groups to its shingles.  Pairs are in proportion to the shared shingles.  The hubs are
        written before they are joined by token, so that a shingle that very many hold can be split in the join.
        """
        rows = shared.select("token", "gid", "n", "pos", "groups")
        weight = common.stored(rows.groupBy("gid").agg(F.sum("groups").alias("weight")))
        weighed = rows.join(common.small_side(weight, 64), "gid")
        hubs = common.stored(weighed.groupBy("token").agg(F.max(F.struct("weight", "gid", "n", "pos")).alias("hub")))
        near = rows.join(hubs, "token").where((F.col("gid") != F.col("hub.gid")) & passes(F.col("n"), F.col("hub.n"), F.col("pos"), F.col("hub.pos"), self.share))
        return near.select(F.col("gid").alias("g1"), F.col("hub.gid").alias("g2"))

    def first_round(self, shared: DataFrame) -> DataFrame:
        close = lambda x: (F.col("gid") != F.col(f"{x}.gid")) & passes(F.col("n"), F.col(f"{x}.n"), F.col("pos"), F.col(f"{x}.pos"), self.share)
        both = F.array_compact(F.array(*[F.when(close(x), F.col(f"{x}.gid")) for x in ("pivot", "prev")]))
        pairs = shared.select(F.col("gid").alias("g1"), F.explode(both).alias("g2")).union(self.hubs(shared)).distinct()
        heads = self.units.groupBy("gid").agg(F.min("fp").alias("head"), F.count("*").alias("members"))
        across = pairs.join(heads.select(F.col("gid").alias("g1"), F.col("head").alias("a")), "g1").join(heads.select(F.col("gid").alias("g2"), F.col("head").alias("b")), "g2").select("a", "b")
        within = self.units.join(heads.where("members > 1"), "gid").where("fp <> head").select(F.col("head").alias("a"), F.col("fp").alias("b"))
        return across.union(within).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def last_round(self, shared: DataFrame, roots: DataFrame, done: DataFrame) -> DataFrame:
        """Pairs of units that share a prefix shingle or a group, are in different components and weren't compared.

        Groups are paired and filtered first, by size, position, components and, where a group is one set, parities; what
        is left is expanded to the groups' members, which are filtered by components and parities.
        """
        named = self.units.select("fp", "gid").join(common.small_side(roots.select(F.col("vertex").alias("fp"), "root"), 128), "fp", "left").select("fp", "gid", F.coalesce("root", "fp").alias("root"))
        label = F.xxhash64("root")
        groups = common.stored(named.groupBy("gid").agg(F.min(label).alias("least"), F.max(label).alias("most"), F.count("*").alias("members")))
        rows = shared.select("token", "gid", "n", "pos").join(common.small_side(groups, 64), "gid")
        mixed = common.stored(rows.groupBy("token").agg(F.min("least").alias("x"), F.max("most").alias("y")).where("x <> y").select("token"))
        rows = common.stored(rows.join(common.small_side(mixed, 32), "token", "left_semi"))
        several = groups.where("least <> most").select("gid")
        members = common.stored(named.join(rows.select("gid").union(several).distinct(), "gid", "left_semi"))
        members = common.stored(members.join(self.parity_of(members.select("fp")), "fp"))
        folds = [F.expr(" ^ ".join(f"p{i}" for i in range(at, WORDS, FOLDED))).alias(f"p{at}") for at in range(FOLDED)]
        rows = common.stored(rows.join(members.join(groups.where("members = 1").select("gid"), "gid", "left_semi").select("gid", *folds), "gid", "left"))
        a, b, x, y = rows.alias("a"), rows.alias("b"), members.alias("x"), members.alias("y")
        apart = F.expr("a.least <> b.least or a.most <> b.most or a.least <> a.most")
        close = passes(F.col("a.n"), F.col("b.n"), F.col("a.pos"), F.col("b.pos"), self.share) & (F.expr("a.p0 is null or b.p0 is null") | may_link("a", "b", self.share, FOLDED))
        pairs = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.gid") < F.col("b.gid")) & apart & close).select(F.col("a.gid").alias("g1"), F.col("b.gid").alias("g2")).distinct()
        pairs = common.stored(pairs)
        members_link = (F.col("x.root") != F.col("y.root")) & may_link("x", "y", self.share)
        across = pairs.join(x, F.col("g1") == F.col("x.gid")).join(y, (F.col("g2") == F.col("y.gid")) & members_link)
        within = members.join(several, "gid", "left_semi")
        within = within.alias("x").join(within.alias("y"), (F.col("x.gid") == F.col("y.gid")) & (F.col("x.fp") < F.col("y.fp")) & members_link)
        found = across.select("x.fp", F.col("y.fp").alias("other")).union(within.select("x.fp", F.col("y.fp").alias("other")))
        return found.select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b")).distinct().join(done, ["a", "b"], "left_anti")

    def run(self) -> DataFrame:
        shared = self.shared_postings()
        pairs = common.stored(self.first_round(shared))
        links = self.verified(common.stored(self.possible(pairs)))
        roots = components(links)
        rest = common.stored(self.last_round(shared, roots, pairs))
        more = self.verified(rest) if not rest.isEmpty() else rest
        if not more.isEmpty():
            roots = components(links.union(more))
        named = self.units.join(common.small_side(roots.select(F.col("vertex").alias("fp"), "root"), 128), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
        smallest = named.groupBy("root").agg(F.min("rep").alias("component_id"))
        by_set = named.join(smallest, "root").select("fp", "component_id", "root")
        linked = self.signed.where("n > 0").select("doc_id", "n", "fp").join(by_set, "fp").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "fp", "root")
        return linked.union(self.signed.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "fp", F.lit(None).cast("binary").alias("root")))


def link(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """doc_id, n_shingles, component_id, fp (fingerprint of the shingle set) and root (one fp of the component, which tells
    components apart where ids are null or repeat; null without shingles) of every document.

    Documents link when 100 * intersection >= share * union of their shingle sets (A-Z lower-cased, words parted by ASCII
    white space; a text of fewer words is one shingle).  component_id is the smallest doc_id reachable by links.

    Null and empty texts and texts without words have no shingles, link with nothing and are their own component.  Equal
    sets always link.  Repeated rows get equal rows.  Null ids are linked but never a component's id, unless all its ids
    are null.  An empty table gives an empty result; further columns are ignored.  Sets are held as 64-bit hashes.
    """
    return Join(docs, id_col, text_col, shingle_words, share).run()


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """docs without all but one document of each component: the one with the smallest id stays.

    Of several rows with that id in a component one stays, in each component, whatever null or repeated ids others have.
    Documents without shingles all stay.
    """
    names = docs.columns
    docs = docs.toDF(*(f"c{i}" for i in range(len(names))))  # the columns' own names may be any
    id_col, text_col = (f"c{[x.lower() for x in names].index(c.lower())}" for c in (id_col, text_col))
    found = link(docs, id_col=id_col, text_col=text_col, shingle_words=shingle_words, share=share).where("n_shingles > 0")
    found = common.stored(found.select("doc_id", "component_id", "fp", "root"))
    heads = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root")
    heads = common.stored(heads.agg(F.min("doc_id").alias("__id"), F.min("fp").alias("__fp")).select("__id", "__fp"))  # one row a component
    # an id of one row names its row; null and repeated ids do so only together with the set
    several = found.groupBy(F.col("doc_id").alias("__many")).agg(F.count("*").alias("__rows")).where("__rows > 1").select("__many")
    several = common.small_side(common.stored(several), 64)
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    empty = F.length(F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+", "")) == 0
    texts, blank = docs.where(~empty), docs.where(empty)
    once = heads.join(several, same("__id", "__many"), "left_anti").select("__id")
    kept = texts.join(common.small_side(common.stored(once), 64), same(id_col, "__id")).drop("__id").union(blank)
    picked = common.stored(heads.join(several, same("__id", "__many"), "left_semi"))
    if picked.isEmpty():
        return kept.toDF(*names)

    def run(batches):
        for batch in batches:
            fps = [xxhash.xxh3_128_digest(shingle_set(text, shingle_words).tobytes()) for text in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps, pa.binary())], names=[*batch.schema.names[:-1], "__set"])

    unclear = texts.join(several, same(id_col, "__many"), "left_semi").withColumn("__text", F.col(text_col).cast("string"))
    unclear = unclear.mapInArrow(run, StructType([*docs.schema.fields, StructField("__set", BinaryType())]))
    unclear = unclear.join(common.small_side(picked, 64), same(id_col, "__id") & (F.col("__set") == F.col("__fp")))
    return kept.union(unclear.dropDuplicates([id_col, "__set"]).drop("__id", "__fp", "__set")).toDF(*names)


def query(spark, sf_dir: str) -> DataFrame:
    """Shingles of four words, similarity of 0.85."""
    return link(common.read(spark, sf_dir, "documents"), shingle_words=4, share=(85, 100)).select("doc_id", "n_shingles", "component_id")
