"""N-gram Jaccard join: size-aware, with fixed-size subsets for small sets and inverted lists for large ones."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.llm.common import Recent, checkpointed, lean, small_side

NGRAM = 4
#: Similarity in hundredths.
SIMILARITY = 85
#: Boundaries between small and large sets of which the cheapest is taken.
BOUNDARIES = (0, 8, 16, 32, 64, 128, 256, 512, 1024, 4096, 1 << 40)
#: Links that one task joins into components; beyond, labels spread in rounds of joins.
LINKS_AT_ONCE = 200_000
#: Rows of two numbers that are broadcast at most.
PAIRS_BROADCAST = 1_000_000
#: Rounds in which the most central member of a list stands for all of it.
HUB_ROUNDS = 1
#: Mean length of open lists, by members, from which members meet their nearest before all meet.
LONG_LISTS = 256


class WordHashes(Recent):
    """64-bit hashes of words."""

    def __init__(self, most: int = 60_000):
        super().__init__(most)

    def make(self, word: bytes) -> int:
        return xxhash.xxh3_64_intdigest(word)


_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _MIX[1]
    h = (h ^ (h >> np.uint64(32))) * _MIX[2]
    return h ^ (h >> np.uint64(29))


def shingle_set(text: str | None, words: WordHashes, ngram: int = NGRAM) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text; with fewer words, of the whole sequence.

    ASCII letters are lower-cased, and words are what ASCII white space
    separates: both as ``bytes`` does them.
    """
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    n = min(ngram, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)  # sequences of other lengths differ
    for k in range(n):
        out = _spread(out * _MIX[0] + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def least_overlap(n: int, similarity: int = SIMILARITY) -> int:
    """What a set of ``n`` has in common with a similar set at least."""
    return -(-similarity * n // 100)


def shared_least(n: int) -> int:
    return max(2, n // 10)


def signature_length(n: int, similarity: int = SIMILARITY) -> int:
    """How many of a set's smallest hashes form its signature.

    Two similar sets, of which the smaller has ``m`` elements, have
    ``shared_least(m)`` hashes or more in common within their signatures: the
    prefix principle, for more than one common element.
    """
    o = least_overlap(n, similarity)
    return n - o + min(o, shared_least(n))


def common_least(n: int, similarity: int = SIMILARITY) -> int:
    """What the signature of a set of ``n`` shares with that of any similar set at least."""
    return min(n, shared_least(least_overlap(n, similarity)))


def smallest_linked(similarity: int = SIMILARITY) -> int:
    """The least size of a set that can be similar to a different one."""
    return next(n for n in range(1, 1000) if 100 * n >= similarity * (n + 1))


def document_sets(docs: DataFrame, id_col: str, text_col: str, ngram: int, similarity: int) -> DataFrame:
    """doc_id, n, digest (null without words) and the signature, which is empty for copies seen before in the same task."""
    least = smallest_linked(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = WordHashes(), set()
        for batch in batches:
            size, digest, signature = [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), words, ngram)
                d = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
                size.append(len(s)), digest.append(d)
                signature.append(s[: signature_length(len(s), similarity)].view(np.int64) if len(s) >= least and d not in seen else None)
                seen.add(d)
                if len(seen) > 1_000_000:
                    seen.clear()
            offsets = np.cumsum([0, *(0 if s is None else len(s) for s in signature)])
            flat = np.concatenate([s for s in signature if s is not None] or [np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))], names=["doc_id", "n", "digest", "signature"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    return rows.mapInArrow(lean(run), "doc_id long, n long, digest binary, signature array<long>")


def whole_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, ngram: int) -> DataFrame:
    """cid, the packed set and its sketch, of each document whose id is in ``wanted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            sets = [shingle_set(t.as_py(), words, ngram) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([sketch(s) for s in sets], pa.binary())], names=["cid", "packed", "sketch"])

    rows = docs.select(F.col(id_col).cast("long").alias("cid"), F.col(text_col).alias("text")).join(small_side(wanted.select("cid"), 1_000_000), "cid", "left_semi")
    return rows.mapInArrow(lean(run), "cid long, packed binary, sketch binary").dropDuplicates(["cid"])


def choose_boundary(costs: list[tuple[int, int, float, float]], similarity: int = SIMILARITY) -> int:
    """The boundary with the least work, from (least n, greatest n, work of subsets, work of lists) of size ranges.

    A key is made, sent and met once; in a list its member meets a hub in each
    round, and a subset's list is short.  Up to the boundary sets are small.  A set near it that a large one may be
    similar to stands in the lists as well.
    """

    def work(x: int) -> float:
        near = least_overlap(x + 1, similarity)
        return sum((subsets if high <= x else lists) + (lists if high <= x and high >= near else 0) for _, high, subsets, lists in costs)

    return min(BOUNDARIES, key=lambda x: (work(x), x))


def rare_first(f: np.ndarray, token: np.ndarray, n: int, similarity: int, extra: int) -> np.ndarray:
    """The shared hashes among the rarest elements of a signature that a join needs; ``extra`` 1 for lists, 2 for subsets of two.

    Elements that no other set has are rarer than all of ``token``.
    """
    alone = signature_length(n, similarity) - len(token)
    length = signature_length(n, similarity) - common_least(n, similarity) + extra
    return token[np.lexsort((token, f))[: max(0, length - alone)]]


POSTING = "key long, cid long, n long, small boolean, central double"


def list_rows(survivors: DataFrame, boundary: int, similarity: int, rows_at_once: int = 100_000) -> DataFrame:
    """Postings: key, cid, n, small, central.

    Keys of small sets are pairs of elements, keys of large sets elements.
    Small sets that a large one may be similar to stand in the lists of
    elements too, marked as small: two of them are left to their subsets.
    """
    near = least_overlap(boundary + 1, similarity)

    def packed(parts: list[tuple[np.ndarray, int, int, bool, float]]) -> pa.RecordBatch:
        size = [len(p[0]) for p in parts]
        columns = [np.repeat(np.array([p[k] for p in parts]), size) for k in range(1, 5)]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[0] for p in parts])), *map(pa.array, columns)], names=["key", "cid", "n", "small", "central"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, int, int, bool, float]] = []
        held = 0
        for batch in batches:
            lists = batch.column(2)
            ends, flat = lists.offsets.to_numpy(), lists.values
            often, tokens = flat.field("f").to_numpy(), flat.field("token").to_numpy()
            for cid, n, lo, hi in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), ends[:-1], ends[1:], strict=True):
                f, token = often[lo:hi], tokens[lo:hi]
                length = signature_length(n, similarity)
                central = float(f.sum() + length - len(f)) / length
                if n <= boundary:
                    first = np.sort(rare_first(f, token, n, similarity, 2)).view(np.uint64)
                    i, j = np.triu_indices(len(first), 1)
                    parts.append((_spread(_spread(first[i]) + first[j]).view(np.int64), cid, n, False, central))
                    held += len(i)
                if n >= near:
                    parts.append((rare_first(f, token, n, similarity, 1), cid, n, n <= boundary, central))
                    held += len(parts[-1][0])
                if held >= rows_at_once:
                    yield packed(parts)
                    parts, held = [], 0
        if parts:
            yield packed(parts)

    return survivors.select("cid", "n", "tokens").mapInArrow(lean(run), POSTING)


def verified(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose whole sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                at = np.searchsorted(large, small)
                both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                keep.append(100 * both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x, y = sets.select(F.col("cid").alias("a"), F.col("packed").alias("x")), sets.select(F.col("cid").alias("b"), F.col("packed").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(lean(run), "a long, b long")


#: Bits of a sketch: as many as keep two unlike sets of some thousands apart.
SKETCH_BITS = 2048
#: Members of a list that are compared with each other at a time.
LIST_BLOCK = 2048


def sketch(s: np.ndarray) -> bytes:
    """For each of the bits, whether an odd number of elements falls on it.

    Two sets differ in as many elements at least as their sketches in bits.
    """
    odd = np.bincount((s & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def near_pairs(cid: np.ndarray, comp: np.ndarray, n: np.ndarray, small: np.ndarray, side: np.ndarray, bits: np.ndarray, similarity: int, nearest: bool) -> np.ndarray:
    """Pairs of different components that may be similar by their sizes and sketches, as rows (smaller id, larger id).

    ``side`` is 0 or 1 for the two blocks of a list that meet here and 2 if
    all are of the same block.  With ``nearest`` each member of the first block
    keeps only the one whose sketch differs least from its own.
    """
    out = []
    first, second = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    for lo in range(0, len(first), 64):
        i, j = first[lo : lo + 64, None], second[None, :]
        total = n[i] + n[j]
        ok = (comp[i] != comp[j]) & (100 * np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j])) & ~(small[i] & small[j])
        if not nearest:
            ok &= (side[i] != 2) | (cid[i] < cid[j])
        a, b = np.nonzero(ok)
        if not len(a):
            continue
        x, y = first[lo + a], second[b]
        most = total[a, b] - 2 * -(-similarity * total[a, b] // (100 + similarity))
        differ = np.concatenate([np.bitwise_count(bits[x[k : k + 65536]] ^ bits[y[k : k + 65536]]).sum(axis=1, dtype=np.int64) for k in range(0, len(x), 65536)])
        keep = differ <= most
        x, y = x[keep], y[keep]
        if nearest and len(x):
            order = np.lexsort((cid[y], differ[keep], x))
            x, y = x[order], y[order]
            best = np.concatenate([[True], x[1:] != x[:-1]])
            x, y = x[best], y[best]
        out.append(np.stack([np.minimum(cid[x], cid[y]), np.maximum(cid[x], cid[y])], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def rest_pairs(members: DataFrame, sets: DataFrame, similarity: int, nearest: bool, block: int = LIST_BLOCK) -> DataFrame:
    """a and b of all members of a list (key, cid, n, small, comp) that are of different components and may be similar.

    Members are compared by sketches inside tasks, and only pairs that pass
    leave them; with ``nearest`` one pair for each member at most.  Lists longer than ``block`` are cut into blocks, and each two
    blocks meet in a group of their own.
    """
    sizes = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    rows = members.join(sizes, "key").join(sets.select("cid", "sketch"), "cid").withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("own", "other").alias("b0"), F.greatest("own", "other").alias("b1"), F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"), "cid", "comp", "n", "small", "sketch")
    grouped = rows.repartition("key", "b0", "b1").sortWithinPartitions("key", "b0", "b1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def groups(part: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            """The pairs of the whole groups; what may go on stays in ``held``."""
            names = np.stack([part.column(k).to_numpy() for k in range(3)], axis=1)
            starts = np.concatenate([[0], 1 + np.flatnonzero((names[1:] != names[:-1]).any(axis=1)), [len(names)]])
            end = starts[-1] if last else starts[-2]
            held[:] = [] if last else part.slice(end).combine_chunks().to_batches()
            side, cid, comp, n, small = (part.column(k).to_numpy() for k in range(3, 8))
            bits = np.frombuffer(b"".join(part.column(8).to_pylist()), np.uint64).reshape(len(names), -1)
            found = [near_pairs(cid[lo:hi], comp[lo:hi], n[lo:hi], small[lo:hi], side[lo:hi], bits[lo:hi], similarity, nearest) for lo, hi in zip(starts[:-1], starts[1:], strict=True) if hi <= end and hi - lo > 1]
            pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 4 * block:
                yield from groups(pa.Table.from_batches(held), False)
        if sum(b.num_rows for b in held):
            yield from groups(pa.Table.from_batches(held), True)

    return grouped.mapInArrow(lean(run), "a long, b long").distinct()


def joined_links(edges: DataFrame) -> DataFrame:
    """cid and comp of links few enough for one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(a), root(b)
                parent[max(a, b)] = min(a, b)
        ids = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(map(root, ids), pa.int64())], names=["cid", "comp"])

    return edges.coalesce(1).mapInArrow(lean(run), "cid long, comp long")


def connected_components(edges: DataFrame, at_once: int = LINKS_AT_ONCE) -> DataFrame:
    """cid and comp, the smallest id reachable, for the ends of ``edges`` (a, b), which are checkpointed.

    Up to ``at_once`` links are joined in one task.  With more, labels fall to
    the least of the neighbours' labels and then to the label of that label,
    until none changes.
    """
    if edges.count() <= at_once:
        return checkpointed(joined_links(edges.select("a", "b")))
    both = checkpointed(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("cid"), F.least("a", "m").alias("comp")))
    while True:
        near = both.join(labels.select(F.col("cid").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("m"))
        fallen = labels.join(near.withColumnRenamed("a", "cid"), "cid").select("cid", F.col("comp").alias("old"), F.least("comp", "m").alias("mid"))
        jump = labels.select(F.col("cid").alias("mid"), F.col("comp").alias("next"))
        new = checkpointed(fallen.join(jump, "mid", "left").select("cid", "old", F.least("mid", F.coalesce("next", "mid")).alias("comp")))
        labels = new.select("cid", "comp")
        if new.where("comp <> old").isEmpty():
            return labels


def link_components(postings: DataFrame, sets: DataFrame, similarity: int, rounds: int = HUB_ROUNDS) -> DataFrame:
    """cid and comp of the sets that are linked, from the postings.

    Two sets that are linked share a key.  First the members of a list meet
    its most central one, so that a list of copies of one text costs a pair for
    each member and not one for each two.  Lists whose members are of one
    component are done with.  Where the others are long, each of their members
    then meets the one of another component whose sketch is nearest, again and
    again until that links nothing new or the lists are short.  At last all members that are still of different
    components are compared, by sketches first, so that no link between
    components is lost.
    """

    def compatible(n: str, m: str):
        return (100 * F.least(n, m) >= similarity * F.greatest(n, m))

    spark = postings.sparkSession
    edges, met, labels = spark.createDataFrame([], "a long, b long"), None, None
    turns = ["hub"] * rounds + ["rest"]
    while turns:
        turn = turns.pop(0)
        now = postings.withColumn("comp", F.col("cid")) if labels is None else postings.join(small_side(labels, PAIRS_BROADCAST), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
        if turn == "rest":
            # The members that an open list's member meets on average, if all meet.
            n = now.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count(F.lit(1)).cast("double").alias("n")).where("c0 < c1").agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0]
            turn = "nearest" if (n or 0.0) > LONG_LISTS else "all"
        lists = now.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.max_by(F.struct("cid", "n", "small", "comp"), F.struct("central", "cid")).alias("hub")).where("c0 < c1")
        if turn == "hub":
            m = now.join(lists.select("key", "hub"), "key").where(F.col("comp") != F.col("hub.comp")).select("key", "cid", "n", "small", F.col("hub.cid").alias("hub_cid"), F.col("hub.n").alias("hub_n"), F.col("hub.small").alias("hub_small"))
            m = m.where(compatible("n", "hub_n") & ~(F.col("small") & F.col("hub_small")))
            pairs = m.select(F.least("cid", "hub_cid").alias("a"), F.greatest("cid", "hub_cid").alias("b")).distinct()
        else:
            pairs = rest_pairs(now.join(lists.select("key"), "key", "left_semi").select("key", "cid", "n", "small", "comp"), sets, similarity, turn == "nearest")
        pairs = checkpointed(pairs if met is None else pairs.join(small_side(met, PAIRS_BROADCAST), ["a", "b"], "left_anti"))
        found = None if pairs.isEmpty() else checkpointed(verified(pairs, sets, similarity))
        if found is not None:
            met = pairs if met is None else met.unionByName(pairs)
            if not found.isEmpty():
                edges = edges.unionByName(found)
                labels = connected_components(edges)
        if turn == "nearest":
            turns.append("rest" if found is not None and not found.isEmpty() else "all")
    return labels if labels is not None else spark.createDataFrame([], "cid long, comp long")


def jaccard_components(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = NGRAM, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles and component_id of every document.

    1. Each text becomes its set of shingle hashes; equal sets become one
       class, named by its smallest id.
    2. The signatures (the smallest hashes) are counted over all classes, and a
       class stays only if it shares with others as much of its signature as a
       similar set would.
    3. What stays is joined by size: small sets by all subsets of two of the
       rarest elements of their signature, large ones by the inverted lists of
       these elements; the boundary is the one with the least work.
    4. Pairs that meet are compared by their whole sets.

    Null and empty texts and those without words have no shingles and stand
    alone.  Rows with a null id are left out; repeated rows give one row.  An
    empty table gives an empty result; other columns are left out.
    """
    rows = checkpointed(document_sets(docs, id_col, text_col, ngram, similarity))
    classes = checkpointed(rows.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("cid"), F.first("n").alias("n"), F.first("signature", ignorenulls=True).alias("signature")))
    tokens = classes.where(F.size("signature") > 0).select("cid", "n", F.explode("signature").alias("token"))
    often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    shared = tokens.join(often, "token").groupBy("cid", "n").agg(F.collect_list(F.struct("f", "token")).alias("tokens"))
    overlap = F.ceil(F.lit(similarity) * F.col("n") / 100)
    least = F.least(F.col("n"), F.greatest(F.lit(2), F.floor(overlap / 10)))
    survivors = checkpointed(shared.where(F.size("tokens") >= least))
    length = F.col("n") - overlap + F.least(overlap, F.greatest(F.lit(2), F.floor(F.col("n") / 10)))
    sorted_tokens = F.sort_array("tokens")

    def firsts(extra: int):
        return F.greatest(F.lit(0), F.size("tokens") - least + extra).cast("int")

    spans = survivors.select("n", firsts(2).alias("k"), F.slice(sorted_tokens, F.lit(1), firsts(1)).alias("first"), length.alias("length"))
    costs = spans.groupBy(F.floor(F.log2("n")).alias("range")).agg(F.min("n"), F.max("n"), F.sum(F.col("k") * (F.col("k") - 1.0)), F.sum(F.aggregate("first", F.lit(0.0), lambda a, t: a + F.least(t["f"], F.lit(HUB_ROUNDS + 1)) + 1.0))).collect()
    boundary = choose_boundary([(r[1], r[2], float(r[3] or 0), float(r[4] or 0)) for r in costs], similarity)
    postings = checkpointed(list_rows(survivors, boundary, similarity))
    sets = checkpointed(whole_sets(docs, survivors, id_col, text_col, ngram))
    labels = link_components(postings, sets, similarity)
    named = classes.select("digest", "cid").join(small_side(labels, PAIRS_BROADCAST), "cid", "left").select("digest", F.coalesce("comp", "cid").alias("component_id"))
    return rows.select("doc_id", "n", "digest").dropDuplicates(["doc_id"]).join(named, "digest", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def row_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with a column _key, a digest of id and text; rows with equal keys have equal ids and texts.

    Keys are compared with a second digest, and made anew from another seed
    where two unlike rows have the same.
    """
    values = [F.col(id_col).isNull(), F.col(id_col), F.col(text_col).isNull(), F.col(text_col)]
    for seed in itertools.count():
        keyed = docs.withColumn("_key", F.xxhash64(F.lit(seed), *values))
        other = F.xxhash64(*values[::-1], F.lit(seed))
        if keyed.groupBy("_key").agg(F.min(other).alias("low"), F.max(other).alias("high")).where("low <> high").isEmpty():
            return keyed


def near_duplicate_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: the one with the smallest id.

    Ids need be neither unique nor given: rows that share an id, or have none,
    are compared by their texts like any others, and only copies and near
    copies go.  Of a component, rows with an id stay rather than rows without;
    rows with the same id and text are one row.  Documents without words have
    no near copies: they stay, also all of those without an id.
    """
    # Near-duplicate stages take five words and a similarity of 0.8.
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    if ids.groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty():
        found = jaccard_components(spark, docs, ngram=5, similarity=80)
        gone = checkpointed(found.where("doc_id <> component_id").select("doc_id"))
        return docs.join(small_side(gone, 1_000_000), "doc_id", "left_anti").select(*docs.columns)
    keyed = row_keys(docs)
    alone = F.col("doc_id").isNull() & ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^ \t\n\r\x0B\f]")
    rows = keyed.where(~alone)
    found = jaccard_components(spark, rows, "_key", "text", ngram=5, similarity=80).select(F.col("doc_id").alias("_key"), "component_id")
    first = rows.groupBy("_key").agg(F.first(F.col("doc_id").cast("long")).alias("id"))
    kept = found.join(first, "_key").groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "_key")).alias("first")).select("first._key")
    gone = checkpointed(found.join(kept, "_key", "left_anti").select("_key"))
    stay = rows.join(small_side(gone, 1_000_000), "_key", "left_anti").dropDuplicates(["_key"])
    return stay.unionByName(keyed.where(alone)).select(*docs.columns)
