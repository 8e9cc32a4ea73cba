"""Near-duplicate documents by MinHash: universal hash minima, banding, signature verification, confirmed links, components.

1. Each text gives the minima of its shingles' hashes under 160 universal functions, in 32 bands of 5. Two texts of
   similarity 0.8 share no band with a probability of 3e-6.
2. Texts with equal shingle sets form a class, and one document stands for it from here on.
3. Of the texts that share a band key, each is a candidate with one leader (another for each key), never with all.
4. Candidates whose signatures agree enough (five deviations below the threshold still pass) are confirmed on their full
   shingle sets: each document's two likeliest partners.
5. Where a key still holds several components, each document outside the largest meets that component's most typical
   document. What then is still apart goes through an exact join on the rarest shingles of the documents of such keys. So
   no link that a band shows can be lost, whatever the leaders said, and groups of copies make few pairs, not all.

Defined results: a null or empty text, or one without words, has no shingles and is linked with nothing; equal texts are
always linked; of a component the document with the least id stays; a null id is linked with nothing; ids are taken to be
unique (rows that repeat an id and a text are one document); texts of any length are shingled whole; an empty table gives
an empty table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealfold.llm import wordhash
from sealfold.llm.common import bloom, bounded_batches, discard, documents, drop_garbage, in_arrow, materialize, packed
from sealfold.llm.components import components, joined
from sealfold.llm.token_counts import texts

BANDS, ROWS = 32, 5
_SEED = 20240229
#: Sizes of sets within this factor of each other are one class.
SIZE_CLASS = 1.03


def _functions() -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and addends of the universal functions x -> (a x + b) mod 2**64 >> 32."""
    rng = np.random.default_rng(_SEED)
    a = rng.integers(0, 2**64, BANDS * ROWS, np.uint64) | np.uint64(1)
    return a, rng.integers(0, 2**64, BANDS * ROWS, np.uint64)


def signatures(run: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Minima (functions, texts) of the shingle hashes; columns of texts without shingles are all ones."""
    out = np.full((BANDS * ROWS, len(at) - 1), 2**32 - 1, np.uint32)
    full = np.flatnonzero(at[1:] > at[:-1])
    if len(full):
        starts, buffer = at[full], np.empty_like(run)
        for i, (a, b) in enumerate(zip(*_functions(), strict=True)):
            np.multiply(run, a, out=buffer)
            np.add(buffer, b, out=buffer)
            out[i, full] = np.minimum.reduceat(buffer, starts) >> np.uint64(32)
    return out


def sketch(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n (distinct shingles), s1 and s2 (sums that stand for the set), sig (a byte a minimum), bands (a key a band)."""

    def run(batches):
        for part, found in texts(batches):
            ids = part.column(0)
            for first, chunk in wordhash.chunks([t.encode() for t in found]):
                hashes, at = wordhash.shingles(chunk, size)
                minima = signatures(hashes, at)
                sums = []
                for salt in (1, 2):
                    total = np.concatenate([[np.uint64(0)], np.cumsum(wordhash.mix(hashes, salt), dtype=np.uint64)])
                    sums.append((total[at[1:]] - total[at[:-1]]).view(np.int64))
                keys = np.zeros((BANDS, len(chunk)), np.uint64)
                for k in range(BANDS):
                    x = np.full(len(chunk), k, np.uint64)
                    for r in range(ROWS):
                        x = wordhash.mix(x * np.uint64(0xD1342543DE82EF95) + minima[k * ROWS + r].astype(np.uint64))
                    keys[k] = x
                low = np.ascontiguousarray((minima & 255).astype(np.uint8).T)
                bands = pa.ListArray.from_arrays(np.arange(0, BANDS * len(chunk) + 1, BANDS, dtype=np.int32), np.ascontiguousarray(keys.T).view(np.int64).ravel())
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, len(chunk)), pa.array(at[1:] - at[:-1]), *map(pa.array, sums), pa.array([x.tobytes() for x in low], pa.binary()), bands],
                    ["doc_id", "n", "s1", "s2", "sig", "bands"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return in_arrow(rows, run, "doc_id long, n long, s1 long, s2 long, sig binary, bands array<long>")


def _agreeing(pairs: DataFrame, sketches: DataFrame, share: float) -> DataFrame:
    """(a, b, est) of the pairs (a, b) whose signatures agree in so large a share of the minima."""
    sig = sketches.select("doc_id", "sig")
    both = pairs.join(sig.withColumnsRenamed({"doc_id": "a", "sig": "sa"}), "a").join(sig.withColumnsRenamed({"doc_id": "b", "sig": "sb"}), "b")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                one, other = (np.frombuffer(b"".join(batch.column(batch.schema.get_field_index(c)).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
                est = (one == other).mean(axis=1)
                keep = pa.array(est >= share)
                a, b = (batch.column(batch.schema.get_field_index(c)) for c in "ab")
                yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep), pa.array(est).filter(keep)], ["a", "b", "est"])

    return in_arrow(both, run, "a long, b long, est double")


def confirmed(pairs: DataFrame, held: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are that similar. ``held`` has the texts by doc_id."""
    both = pairs.select("a", "b").join(held.withColumnsRenamed({"doc_id": "a", "text": "ta"}), "a").join(held.withColumnsRenamed({"doc_id": "b", "text": "tb"}), "b")

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                a, b, ta, tb = (part.column(part.schema.get_field_index(c)) for c in ("a", "b", "ta", "tb"))
                ids = dict(zip(a.to_pylist() + b.to_pylist(), ta.to_pylist() + tb.to_pylist(), strict=True))
                sets, order = {}, list(ids)
                for at, chunk in wordhash.chunks([ids[i].encode() for i in order]):
                    hashes, ends = wordhash.shingles(chunk, size)
                    sets.update({order[at + k]: hashes[ends[k] : ends[k + 1]] for k in range(len(chunk))})
                keep = []
                for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
                    shared = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    keep.append(100 * shared >= percent * (len(sets[x]) + len(sets[y]) - shared))
                yield pa.RecordBatch.from_arrays([a.filter(pa.array(keep)), b.filter(pa.array(keep))], ["a", "b"])

    return in_arrow(both, run, "a long, b long")


def _labelled(frame: DataFrame, labels: DataFrame, column: str, to: str) -> DataFrame:
    """frame with the component of the node in ``column``; a node without links is its own."""
    named = labels.withColumnsRenamed({"node": column, "component": to})
    return frame.join(named, column, "left").withColumn(to, F.coalesce(to, column))


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    return _labelled(_labelled(pairs, labels, "a", "ca"), labels, "b", "cb").where("ca <> cb").select(pairs.columns)


def _ends(candidates: DataFrame) -> DataFrame:
    """x, a, b, est: each candidate pair for either end."""
    return candidates.select(F.col("a").alias("x"), "a", "b", "est").union(candidates.select(F.col("b").alias("x"), "a", "b", "est"))


def _likeliest(candidates: DataFrame) -> DataFrame:
    """The pairs (a, b) that are the likeliest of one of their ends."""
    best = _ends(candidates).groupBy("x").agg(F.max(F.struct("est", F.xxhash64("a", "b").alias("h"), "a", "b")).alias("best"))
    return best.select("best.a", "best.b").distinct()


def _split(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, key, m, c and top for the keys that hold several components: a document's component, and the key's largest."""
    own = materialize(_labelled(buckets.select("doc_id", "key", "m"), labels, "doc_id", "c"), "own")
    parts = own.groupBy("key", "c").agg(F.count(F.lit(1)).alias("k"), F.max("m").alias("m")).where("k < m")
    tops = materialize(parts.groupBy("key").agg(F.max(F.struct("k", "c")).alias("top")).select("key", F.col("top.c").alias("top")), "tops")
    found = materialize(own.join(tops, "key"), "split")
    discard(own, tops)
    return found


def _sharing_rare(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) in different components, one of them outside, that can be that similar: an exact prefix join.

    Of sets of n and s shingles that are so similar, the n - overlap + 1 rarest of the one and the s - overlap + 1 rarest
    of the other have a shingle in common, in any one order of rarity. What many copies share is not rare, so it joins
    nothing. Partners are told apart by classes of their size, within which the overlap needed is nearly one number. The first
    shingle that two sets share, in that order, leaves either of them only what follows it to share; where that is too little,
    the pair is never made.
    """

    def run(batches):
        for part, found in texts(batches, 256):
            for first, chunk in wordhash.chunks([t.encode() for t in found]):
                hashes, at = wordhash.shingles(chunk, size)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), hashes.view(np.int64))
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)).slice(first, len(chunk)) for c in ("doc_id", "outside", "c")), lists], ["doc_id", "outside", "c", "hashes"])

    sets = in_arrow(rows.select("doc_id", "outside", "c", "text"), run, "doc_id long, outside boolean, c long, hashes array<long>")
    each = materialize(sets.select("doc_id", "outside", "c", F.size("hashes").alias("n"), F.explode("hashes").alias("h")), "shingles")
    # A shingle of one document finds no partner; it only takes up a place among the rarest. Stored, so that hot ones can be split in the join.
    often = materialize(each.groupBy("h").agg(F.count(F.lit(1)).alias("often")).where("often > 1"), "often")
    shared = each.join(often, "h").groupBy("doc_id", "outside", "c", "n").agg(F.sort_array(F.collect_list(F.struct("often", "h"))).alias("order"))  # a text's shingles
    p = percent
    own = F.col("n") - F.size("order")  # shingles that no other document has
    places = F.col("n") - F.ceil(p * F.col("n") / 100).cast("int") + 1
    prefix = shared.where(own < places).select("doc_id", "outside", "c", "n", own.alias("own"), F.posexplode(F.slice("order", 1, places - own)).alias("at", "x"))
    prefix = prefix.withColumn("at", F.col("at") + F.col("own")).drop("own")
    of = lambda s: F.floor(F.log(s) / F.lit(float(np.log(SIZE_CLASS))) + 1e-9).cast("int")
    most = F.least((F.col("n") - F.col("at")) * (100 + p) / p - F.col("n"), 100 * F.col("n") / p)
    least = F.greatest(F.ceil(p * F.col("n") / 100), F.lit(1))
    able = prefix.where(most >= least).withColumn("other", F.explode(F.sequence(of(least), of(most))))
    entry = materialize(able.select(F.col("x.h").alias("h"), "doc_id", "outside", "c", of(F.col("n")).alias("own"), "other", "n", (F.col("n") - F.col("at")).alias("rest")), "prefixes")
    discard(each, often)
    left = entry.where("outside").select("h", "own", "other", F.col("doc_id").alias("l"), F.col("c").alias("cl"), F.col("n").alias("nl"), F.col("rest").alias("rl"))
    right = entry.select("h", F.col("other").alias("own"), F.col("own").alias("other"), F.col("doc_id").alias("r"), F.col("c").alias("cr"), F.col("outside").alias("both"), F.col("n").alias("nr"), F.col("rest").alias("rr"))
    pairs = left.join(right, ["h", "own", "other"]).where(f"cl <> cr and (not both or l < r) and {100 + p} * least(rl, rr) >= {p} * (nl + nr)")
    found = materialize(pairs.select(F.least("l", "r").alias("a"), F.greatest("l", "r").alias("b")).distinct(), "rare")
    discard(entry)
    return found


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs."""
    share = max(0.0, percent / 100 - 5 * (0.25 / (BANDS * ROWS)) ** 0.5 * (4 * (percent / 100) * (1 - percent / 100)) ** 0.5)
    spark = docs.sparkSession
    bounded_batches(spark)
    sketches = materialize(sketch(docs, size), "sketches")
    alike, usable = ["n", "s1", "s2"], F.expr("n > 0 and doc_id is not null")
    # Joins to groups: the groups are stored first, so both sides are plain exchanges and adaptive execution splits the rows of a hot group.
    classes = materialize(sketches.where(usable).groupBy(*alike).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k"), "classes")
    named = sketches.join(classes, alike, "left").withColumn("rep", F.when(usable, F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id")))
    stands = usable & (F.col("doc_id") == F.col("rep"))
    members = materialize(named.select("doc_id", "n", "rep", *[F.when(stands, F.col(c)).alias(c) for c in ("sig", "bands")]), "members")
    discard(sketches, classes)
    reps = members.where("bands is not null").select("doc_id", "sig", "bands")
    keyed = reps.select("doc_id", F.explode("bands").alias("key"))
    # The least of id xor key is an id, and another one for each key: a leader that partial aggregation can find.
    keys = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min(F.col("doc_id").bitwiseXOR(F.col("key"))).alias("x")).where("m > 1").select("key", "m", F.col("x").bitwiseXOR(F.col("key")).alias("leader"))
    keys = materialize(keys, "keys")
    buckets = materialize(keyed.join(keys, "key"), "buckets")
    star = buckets.where("doc_id <> leader").select(F.least("doc_id", "leader").alias("a"), F.greatest("doc_id", "leader").alias("b")).distinct()
    candidates = materialize(_agreeing(star, reps, share), "candidates")
    ids = materialize(buckets.select("doc_id").distinct(), "ids")
    discard(keys)
    drop_garbage(spark)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    table = bloom(ids, "doc_id", ids.count())
    near = table.maybe(text, "doc_id").where("maybe").drop("maybe")  # only these texts are shuffled
    held = materialize(near.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "texts")
    discard(ids, table.words)
    drop_garbage(spark)

    first = _likeliest(candidates)
    second = _likeliest(candidates.join(first, ["a", "b"], "left_anti"))
    tried = materialize(first.union(second).distinct(), "likeliest")
    links = materialize(confirmed(tried, held, size, percent), "links")
    labels = components(links)
    drop_garbage(spark)

    # Keys that hold several components: first each document outside the largest one meets that component's most typical
    # document, the one most like its candidates on the whole: what copies were made from is closer to all than they are.
    split = _split(buckets, labels)
    typical = _ends(candidates).groupBy("x").agg(F.avg("est").alias("near")).withColumnRenamed("x", "doc_id")
    hub = split.where("c = top").join(typical, "doc_id").groupBy("key").agg(F.max(F.struct("near", "doc_id")).alias("hub")).select("key", F.col("hub.doc_id").alias("hub"))
    hub = materialize(hub, "hubs")
    met = split.where("c <> top").join(hub, "key").select(F.least("doc_id", "hub").alias("a"), F.greatest("doc_id", "hub").alias("b")).distinct()
    met = materialize(_agreeing(met.join(tried, ["a", "b"], "left_anti"), reps, share).select("a", "b"), "third")
    labels = joined(labels, materialize(confirmed(met, held, size, percent), "links"))
    drop_garbage(spark)

    # What is still apart can only be linked by rare shingles: an exact join finds such pairs.
    still = _split(split.select("doc_id", "key", "m"), labels)
    sides = materialize(still.groupBy("doc_id").agg(F.max(F.col("c") != F.col("top")).alias("outside"), F.first("c").alias("c")), "sides")
    discard(buckets, candidates, split, hub, still)
    pairs = _sharing_rare(held.join(sides, "doc_id"), size, percent)
    last = materialize(confirmed(pairs.join(tried.union(met), ["a", "b"], "left_anti"), held, size, percent), "links")
    labels = joined(labels, last)
    drop_garbage(spark)
    named = members.select("doc_id", "n", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    out = materialize(named.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id")), "found")
    discard(members, held, tried, met, sides, pairs)
    return out


def deduplicate(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay, one of each component, with all their columns."""
    found = near_duplicates(docs, size, percent)
    # Ids that go, and ids that several rows have, are few: rows with any other id pass straight through.
    each = found.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("component_id").alias("c"))
    odd = materialize(each.where("n > 1 or c <> doc_id").select("doc_id", (F.col("c") == F.col("doc_id")).alias("stays")), "odd")
    rows = docs.select(packed(docs).alias("row"), F.col("doc_id").cast("long").alias("doc_id"))
    rows = bloom(odd, "doc_id", odd.count()).maybe(rows, "doc_id")
    maybe = rows.where("maybe").join(odd, "doc_id", "left")
    out = [rows.where("not maybe"), maybe.where("stays is null"), maybe.where("stays").dropDuplicates(["doc_id"])]
    return out[0].select("row").unionByName(out[1].select("row")).unionByName(out[2].select("row")).select("row.*")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir), size=4)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
