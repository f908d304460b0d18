"""Operator 6: n-gram Jaccard join over a token-group matrix.

A document's set holds the 64-bit hashes of its distinct n-word shingles.
Documents with equal sets are one class; one set of each class goes on, under a
number of its own, so that rows that share a doc_id don't hide each other.

Tokens stand in one global order: those whose hash lies in a band (a fifth of all
for a threshold of 0.9) by the exact number of representatives that hold them, then
the others by hash.  Two sets that link share a token among the first
``n - ceil(t * n) + 1`` of each, so only these are posted.  Tokens that one set alone
holds come first and are only counted, so a document that has enough of its own is
done; posted tokens that several documents share form the rows of the matrix:

1. the head of each such row (most copies, then smallest id) draws the row's other
   documents into its group of similar documents and is compared with them, which
   connects most near copies at a cost in proportion to their number;
2. within a group, documents that aren't connected yet meet in blocks.  The block's
   token union gives each pair a bound on its overlap; only documents whose bound
   reaches the threshold are opened, with their whole sets, and compared exactly.

Two documents that share a posted token are in that token's group, so no link
between groups is lost, and pairs exist only inside a block of a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalith.llm.common import WORD, bound_batches, discard, map_batches, tidy, written

#: Members of one part of a group, and queries that meet it in one task, at most.
PART = 512
#: Columns of the token-group matrix that are held at once.
MATRIX_COLUMNS = 4096
#: Words of 64 bits, at most, in the filter that keeps unwanted texts out of a shuffle
#: (16 MB, for eight million ids); more ids are joined instead.
FILTER_WORDS = 1 << 21
#: Rows that are broadcast, at most; more are joined by a shuffle.
SMALL = 400_000

_BASE = 0x9E3779B97F4A7C13
_TABLE = np.random.default_rng(20).integers(1, 1 << 64, 256, dtype=np.uint64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


@dataclass(frozen=True)
class Rule:
    """Shingles of ``words`` words; sets link if intersection / union >= num / den."""

    words: int = 5
    num: int = 8
    den: int = 10

    def links(self, common: int, a: int, b: int) -> bool:
        return self.den * common >= self.num * (a + b - common) and common > 0

    @property
    def band(self) -> int:
        """Hashes below it are in the band: somewhat more tokens than are posted.

        At most half of all, as Spark orders the hashes as signed numbers.
        """
        return int(min(0.499, 1.5 * (1 - self.num / self.den) + 0.05) * 2**64) - 1

    def needed(self, n: int) -> int:
        return -(-n * self.num // self.den)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 2 * len(_POWERS[0]), 1 << 16)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; of the whole text if it has fewer words."""
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(b" ".join(found), np.uint8)
    up, down = _powers(len(raw) + 1)
    running = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_TABLE[raw] * up[:-1], out=running[1:])
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = min(words, len(found))
    starts, ends = starts[: len(found) - n + 1], ends[n - 1 :]
    return np.unique(mixed((running[ends] - running[starts]) * down[starts] + (ends - starts).astype(np.uint64)))


def signature(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


SETS = "doc_id long, n long, posts long, sig binary, band array<long>, extra array<long>"
_SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("posts", pa.int64()), ("sig", pa.binary()), ("band", pa.list_(pa.int64())), ("extra", pa.list_(pa.int64()))])
_TOKENS = pa.schema([("doc_id", pa.int64()), ("sig", pa.binary()), ("tokens", pa.binary())])


def scan_sets(docs: DataFrame, rule: Rule) -> DataFrame:
    """For each document its set's size, digest, number of tokens to post, and the tokens to post from.

    ``band`` has the tokens of the band; where these are fewer than are to be
    posted, ``extra`` has the next ones by hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = np.uint64(rule.band)
        for batch in batches:
            sets = [shingle_set(text, rule.words) for text in batch.column(1).to_pylist()]
            posts = [len(t) - rule.needed(len(t)) + 1 if len(t) else 0 for t in sets]
            inside = [int(np.searchsorted(t, limit, "right")) for t in sets]
            lists = lambda parts: pa.array([t.view(np.int64) for t in parts], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, sets), pa.int64()), pa.array(posts, pa.int64()), pa.array(map(signature, sets), pa.binary()), lists(t[:k] for t, k in zip(sets, inside, strict=True)), lists(t[k:p] for t, k, p in zip(sets, inside, posts, strict=True))],
                schema=_SETS,
            )

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, SETS)


def post(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The posted tokens (token, key, n, copies) of distinct sets, and what is known of each.

    ``sets`` has key, n, posts, copies, band, extra.  Known of a set are the
    tokens of the band that it alone holds (their number), the posted ones it
    shares, as (df, token) in order, and whether these are all it shares.
    """
    rows = sets.select("key", F.explode("band").alias("token"))
    counts = rows.groupBy("token").agg(F.least(F.count("*"), F.lit(2**24 - 1)).alias("df")).where("df > 1")
    own = Window.partitionBy("key")
    ranked = rows.join(counts, "token").withColumns({"place": F.row_number().over(own.orderBy("df", "token")), "shared": F.count("*").over(own)})
    about = sets.select("key", "n", "posts", "copies", F.size("band").alias("inside"))
    ranked = ranked.join(about, "key").withColumn("alone", F.col("inside") - F.col("shared")).where(F.col("alone") + F.col("place") <= F.col("posts"))
    ranked = written(ranked.select("token", "df", "key", "n", "copies", "alone", (F.col("alone") + F.col("shared") <= F.col("posts")).alias("complete")), "jaccard-posts")
    extra = sets.where(F.size("extra") > 0).select(F.explode("extra").alias("token"), "key", "n", "copies")
    known = ranked.groupBy("key").agg(F.first("n").alias("n"), F.first("alone").alias("alone"), F.first("complete").alias("complete"), F.sort_array(F.collect_list(F.struct("df", "token"))).alias("posted"))
    only = sets.where(F.size("extra") > 0).select("key", "n").join(ranked.select("key").distinct(), "key", "left_anti")
    only = only.select("key", "n", F.lit(0).alias("alone"), F.lit(True).alias("complete"), F.array().cast("array<struct<df:bigint,token:bigint>>").alias("posted"))
    return ranked.select("token", "key", "n", "copies").unionByName(extra), written(known.unionByName(only), "jaccard-known")


def id_filter(ids: DataFrame, n: int) -> np.ndarray:
    """A filter that lets all ``n`` ids (column doc_id) pass, and few others: 16 bits or more for each."""
    words = 1 << max(10, (n // 4).bit_length())
    places = F.explode(F.array(F.xxhash64("doc_id", F.lit(1)), F.xxhash64("doc_id", F.lit(2))))
    bits = ids.select(places.alias("h")).select(F.pmod(F.col("h"), F.lit(words)).alias("word"), F.expr("shiftleft(1L, cast(pmod(shiftright(h, 32), 64) as int))").alias("bit"))
    found = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(words, np.int64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out.view(np.uint64)


def scan_wanted(docs: DataFrame, rule: Rule, places: DataFrame, reps: DataFrame) -> DataFrame:
    """``places`` (with a key) and the whole set of each key, as bytes.

    Only texts of wanted documents are cut into sets: up to a number of ids by a
    filter of known size that travels with the tasks, beyond it by a join.
    """
    wanted = written(places.select("key").distinct().join(reps.select("key", "doc_id", "sig"), "key"), "jaccard-wanted")
    n = wanted.count()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    by_filter = n <= 4 * FILTER_WORDS
    if by_filter:
        shared = docs.sparkSession.sparkContext.broadcast(id_filter(wanted, n))
        rows = rows.select("doc_id", F.xxhash64("doc_id", F.lit(1)).alias("h1"), F.xxhash64("doc_id", F.lit(2)).alias("h2"), "text")
    else:
        ids = wanted.select(F.col("doc_id").alias("id")).distinct()
        rows = rows.join(ids, rows["doc_id"].eqNullSafe(ids["id"]), "left_semi").select("doc_id", F.lit(0).alias("h1"), F.lit(0).alias("h2"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value if by_filter else None
        for batch in batches:
            if bits is not None:
                fine = np.ones(batch.num_rows, bool)
                for column in (1, 2):
                    h = batch.column(column).to_numpy()
                    fine &= (bits[h % len(bits)] >> ((h >> 32) % 64).astype(np.uint64)) & np.uint64(1) == 1
                batch = batch.filter(pa.array(fine))
            sets = [shingle_set(text, rule.words) for text in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(signature, sets), pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], schema=_TOKENS)

    found, w = map_batches(rows, run, "doc_id long, sig binary, tokens binary").alias("f"), small(wanted, n).alias("w")
    found = found.join(w, (F.col("f.sig") == F.col("w.sig")) & F.col("f.doc_id").eqNullSafe(F.col("w.doc_id"))).select("w.key", "f.tokens")
    return places.join(found.dropDuplicates(["key"]), "key")


Known = tuple[int, int, bool, np.ndarray]  # size of the set, tokens it alone holds, whether all shared ones are posted, their keys in order


def keys(posted: list[dict]) -> np.ndarray:
    """(df, token) as one number that keeps the order."""
    df = np.fromiter((x["df"] for x in posted), np.uint64, len(posted))
    token = np.fromiter((x["token"] for x in posted), np.int64, len(posted)).view(np.uint64)
    rare = np.minimum(df, np.uint64(2**24 - 1))  # commoner ones by token alone, see ``post``
    return np.unique((rare << np.uint64(40)) | (token >> np.uint64(24)))


def may_link(rule: Rule, xs: list[Known], ys: list[Known]) -> np.ndarray:
    """Which of the xs may link with which of the ys, by what is known of their tokens.

    The token-group matrix of a block: rows are documents, columns the posted tokens
    that the two sides share.  A posted token that comes before the end of what the
    other document posts, yet isn't posted there, isn't in the other set at all; nor
    is a token that one set alone holds.
    """
    n, m = np.array([x[0] for x in xs])[:, None], np.array([y[0] for y in ys])[None, :]
    left, right = [x[3] for x in xs], [y[3] for y in ys]
    union = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    both = np.zeros((len(xs), len(ys)), np.float32)

    def cells(rows: list[np.ndarray], columns: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), len(columns)), np.float32)
        for i, tokens in enumerate(rows):
            at = np.minimum(np.searchsorted(columns, tokens), len(columns) - 1)
            out[i, at[columns[at] == tokens]] = 1
        return out

    for at in range(0, len(union), MATRIX_COLUMNS):
        columns = union[at : at + MATRIX_COLUMNS]
        both += cells(left, columns) @ cells(right, columns).T
    ends = lambda known: np.array([2**64 - 1 if k[2] or not len(k[3]) else k[3][-1] for k in known], np.uint64)
    x_ends, y_ends = ends(xs), ends(ys)
    x_missing = np.stack([np.searchsorted(x[3], y_ends, "right") + x[1] for x in xs]) - both
    y_missing = np.stack([np.searchsorted(y[3], x_ends, "right") + y[1] for y in ys], axis=1) - both
    need = -(-rule.num * (n + m) // (rule.num + rule.den))
    sized = rule.den * np.minimum(n, m) >= rule.num * np.maximum(n, m)
    return sized & (n - x_missing >= need) & (m - y_missing >= need)


def knowns(group: pa.Table) -> list[Known]:
    return [(n, a, c, keys(p)) for n, a, c, p in zip(*(group.column(x).to_pylist() for x in ("n", "alone", "complete", "posted")), strict=True)]


def exact(rule: Rule, a: np.ndarray, b: np.ndarray) -> bool:
    if rule.den * min(len(a), len(b)) < rule.num * max(len(a), len(b)):
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return rule.links(int((b[at] == a).sum()), len(a), len(b))


def small(df: DataFrame, rows: int) -> DataFrame:
    """To be broadcast if ``rows``, a checked size, allows it."""
    return F.broadcast(df) if rows <= SMALL else df


def hashed(seed: int, parts: str) -> Column:
    return F.pmod(F.xxhash64("key", F.lit(seed)), F.col(parts)).cast("int")


def numbers(parts: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(parts) - 1))


def open_heads(docs: DataFrame, rule: Rule, known: DataFrame, star: DataFrame, reps: DataFrame) -> DataFrame:
    """Links (a, b) of the heads a with the sets b of their groups: (grp, key) in ``star``.

    A head meets its sets in lots of PART.  What the posted tokens rule out goes
    before whole sets are fetched.  Only groups of several lots, which are few, are
    looked up to deal their sets, so a hot group is never in one task.
    """
    bound_batches(docs.sparkSession)
    lots = written(star.groupBy("grp").agg(F.ceil(F.count("*") / PART).cast("int").alias("lots")), "jaccard-lots")
    several = lots.where("lots > 1")
    asked = star.join(small(several, several.count()), "grp", "left").withColumn("lots", F.coalesce("lots", F.lit(1)))
    asked = asked.select("grp", hashed(4, "lots").alias("lot"), "key", F.lit(False).alias("head"))
    heads = lots.select("grp", numbers("lots").alias("lot"), F.col("grp").alias("key"), F.lit(True).alias("head"))
    places = heads.unionByName(asked)

    def bound(group: pa.Table) -> pa.Table:
        sets, head = knowns(group), np.array(group.column("head").to_pylist(), bool)
        fine = np.zeros(len(sets), bool)
        h, d = np.flatnonzero(head), np.flatnonzero(~head)
        if len(h) and len(d):
            fine[d] = may_link(rule, [sets[h[0]]], [sets[i] for i in d])[0]
            fine[h] = fine[d].any()
        return group.select(["grp", "lot", "key", "head"]).filter(pa.array(fine))

    places = written(places.join(known, "key").groupBy("grp", "lot").applyInArrow(bound, "grp long, lot int, key long, head boolean"), "jaccard-heads")
    rows = scan_wanted(docs, rule, places, reps)

    def run(group: pa.Table) -> pa.Table:
        ids, head = group.column("key").to_pylist(), group.column("head").to_pylist()
        sets = [np.frombuffer(t, np.uint64) for t in group.column("tokens").to_pylist()]
        a, b = [], []
        for h in (i for i, x in enumerate(head) if x):
            b += [ids[i] for i, x in enumerate(head) if not x and exact(rule, sets[i], sets[h])]
            a += [ids[h]] * (len(b) - len(a))
        if len(ids) > PART // 4:
            tidy()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return written(rows.groupBy("grp", "lot").applyInArrow(run, "a long, b long"), "jaccard-links")


MEMBERS = "grp long, low int, high int, asks boolean, asked boolean, minor boolean, key long, label long"


def open_groups(docs: DataFrame, rule: Rule, known: DataFrame, members: DataFrame, reps: DataFrame) -> DataFrame:
    """Links (a, b) between members (grp, key, label) of a group that aren't connected yet.

    In a group of more than PART members those outside its commonest label ask, in
    parts of PART, and meet all its members, in parts of PART; members that are
    connected already don't meet.  Each pair of parts is one task, a token-group
    matrix.  Only sets that the bound lets link with one of another label are
    opened, which is where whole sets are fetched and compared.  One link for each
    pair of labels is enough.
    """
    bound_batches(docs.sparkSession)
    by_label = members.groupBy("grp", "label").agg(F.count("*").alias("n"))
    groups = by_label.groupBy("grp").agg(F.sum("n").alias("size"), F.max(F.struct("n", "label")).alias("most"), F.count("*").alias("labels")).where("labels > 1")
    parts = lambda n: F.ceil(n / PART).cast("int")
    groups = groups.select("grp", F.col("most.label").alias("major"), parts(F.col("size") - F.col("most.n")).alias("q"), parts(F.col("size")).alias("p"))
    groups = written(groups, "jaccard-groups")
    rows = members.join(small(groups, groups.count()), "grp").withColumn("minor", (F.col("p") == 1) | (F.col("label") != F.col("major")))
    own = [F.col(c) for c in ("grp", "key", "label", "minor")]
    flags = lambda asks, asked: [F.lit(asks).alias("asks"), F.lit(asked).alias("asked")]
    alone = rows.where("p = 1").select(*own, F.lit(0).alias("low"), F.lit(0).alias("high"), *flags(True, True))
    asks = rows.where("p > 1 and minor").select(*own, hashed(3, "q").alias("low"), numbers("p").alias("high"), *flags(True, False))
    asked = rows.where("p > 1").select(*own, numbers("q").alias("low"), hashed(5, "p").alias("high"), *flags(False, True))
    places = alone.unionByName(asks).unionByName(asked)

    def pairs(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Those that ask, those that are asked, and which of them are to meet: of two that both ask, one way is enough."""
        flag = lambda c: np.array(group.column(c).to_pylist(), bool)
        x, y = np.flatnonzero(flag("asks")), np.flatnonzero(flag("asked"))
        key, label = group.column("key").to_numpy(), group.column("label").to_numpy()
        meet = (label[x][:, None] != label[y][None, :]) & (~flag("minor")[y][None, :] | (key[x][:, None] < key[y][None, :]))
        return x, y, meet

    def bound(group: pa.Table) -> pa.Table:
        sets, fine = knowns(group), np.zeros(group.num_rows, bool)
        x, y, meet = pairs(group)
        if meet.any():
            hit = may_link(rule, [sets[i] for i in x], [sets[i] for i in y]) & meet
            fine[x] |= hit.any(axis=1)
            fine[y] |= hit.any(axis=0)
        return group.select([c.split()[0] for c in MEMBERS.split(", ")]).filter(pa.array(fine))

    places = written(places.join(known, "key").groupBy("grp", "low", "high").applyInArrow(bound, MEMBERS), "jaccard-members")
    rows = scan_wanted(docs, rule, places, reps)

    def run(group: pa.Table) -> pa.Table:
        ids, label = group.column("key").to_pylist(), group.column("label").to_pylist()
        sets = [np.frombuffer(t, np.uint64) for t in group.column("tokens").to_pylist()]
        x, y, meet = pairs(group)
        n = np.fromiter(map(len, sets), np.int64, len(sets))
        meet &= rule.den * np.minimum(n[x][:, None], n[y][None, :]) >= rule.num * np.maximum(n[x][:, None], n[y][None, :])
        same: dict[int, int] = {}

        def top(k: int) -> int:
            while same.get(k, k) != k:
                k = same[k]
            return k

        a, b = [], []
        for i, j in np.argwhere(meet):
            i, j = x[i], y[j]
            p, q = top(label[i]), top(label[j])
            if p != q and exact(rule, sets[i], sets[j]):
                same[max(p, q)] = min(p, q)
                a.append(ids[i])
                b.append(ids[j])
        if len(ids) > PART // 4:
            tidy()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return written(rows.groupBy("grp", "low", "high").applyInArrow(run, "a long, b long"), "jaccard-links")


def components(links: DataFrame) -> DataFrame:
    """(key, label): the smallest key that each linked key reaches.

    Labels spread along links and then jump to their label's label, so long chains
    take few rounds; each round is written to the shared folder, and the round
    before it removed.
    """
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "jaccard-edges")
    labels = written(both.groupBy(F.col("a").alias("key")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "jaccard-labels")
    while True:
        near = both.join(labels, both["b"] == labels["key"]).groupBy("a").agg(F.min("label").alias("near"))
        moved = labels.join(near, labels["key"] == near["a"]).select("key", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        moved = written(moved, "jaccard-moved")
        up = moved.select(F.col("key").alias("parent"), F.col("label").alias("top"))
        new = written(moved.join(up, moved["label"] == up["parent"]).select("key", "old", F.least("label", "top").alias("label")), "jaccard-labels")
        done = new.where("label != old").isEmpty()
        discard(moved, labels)
        if done:
            discard(both)
            return new.select("key", "label")
        labels = new


def same_id_links(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the sets of rows that share a doc_id."""
    several = sets.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("sig").alias("low"), F.max("sig").alias("high")).where("low != high")
    several = written(several.select("doc_id"), "jaccard-repeated")
    n = several.count()
    rows = sets.where("n > 0").join(small(several, n), "doc_id").select("doc_id", "sig").distinct().join(classes.select("sig", "key"), "sig")
    first = rows.groupBy("doc_id").agg(F.min("key").alias("a"))
    return rows.join(first, "doc_id").where("key != a").select("a", F.col("key").alias("b")) if n else several.select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))


def jaccard_classes(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs``.

    component_id is the smallest doc_id that links reach, the document's own
    included.  Documents without words (or null) have an empty set and link with
    nothing.  Rows with the same doc_id are one document of the graph, with several
    sets: what links with any of them is in its component.  Rows without a doc_id
    link as others do, and count for nothing as ids.  An empty table gives no rows;
    further columns are ignored.
    """
    scanned = written(scan_sets(docs, rule), "jaccard-sets")
    sets = written(scanned.select("doc_id", "n", "sig"), "jaccard-documents")
    classes = sets.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    classes = written(classes.withColumn("key", F.monotonically_increasing_id()), "jaccard-classes")  # numbered as it is written
    reps = classes.select("key", F.col("rep").alias("doc_id"), "sig")
    c, d = classes.alias("c"), scanned.where("n > 0").alias("d")
    fresh = d.join(c, (F.col("d.sig") == F.col("c.sig")) & F.col("d.doc_id").eqNullSafe(F.col("c.rep")))
    fresh = fresh.select("c.key", "d.n", "d.posts", "c.copies", "d.band", "d.extra").dropDuplicates(["key"])
    fresh = written(fresh, "jaccard-reps")
    discard(scanned)
    posts, known = post(fresh)
    heads = posts.groupBy("token").agg(F.count("*").alias("size"), F.min(F.struct((-F.col("copies")).alias("rank"), "key", "n")).alias("head")).where("size > 1")
    shared = written(posts.join(heads.select("token", "head"), "token").select("token", "key", "n", F.col("head.key").alias("head"), F.col("head.n").alias("head_n")), "jaccard-shared")

    star = written(shared.where(F.col("key") != F.col("head")).select(F.col("head").alias("grp"), "key", F.col("n"), "head_n").distinct(), "jaccard-star")
    sized = rule.den * F.least("n", "head_n") >= rule.num * F.greatest("n", "head_n")
    links = open_heads(docs, rule, known, star.where(sized).select("grp", "key"), reps).unionByName(same_id_links(sets, classes))
    labels = components(links)

    # what remains: sets of one group that aren't connected yet; any two that
    # share a posted token are in the group of that token's head
    members = star.join(labels, "key", "left").select("grp", "key", F.coalesce("label", "key").alias("label"))
    more = open_groups(docs, rule, known, members, reps)
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    linked = classes.join(labels, "key")
    least = written(linked.groupBy("label").agg(F.min("rep").alias("component")), "jaccard-components")
    linked = linked.join(small(least, least.count()), "label").select("key", "component")
    component = classes.join(linked, "key", "left").select("sig", F.coalesce("component", "rep").alias("component"))
    out = sets.join(component, "sig", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each_class(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The rows of ``docs`` that stand for their class: those with the smallest id.

    Rows without words and rows without an id stay; of rows that share that id the
    one with the first text stays.
    """
    classes = written(jaccard_classes(docs, rule), "jaccard-result")
    gone = written(classes.where("component_id != doc_id").select("doc_id").distinct(), "jaccard-gone")
    kept = docs.join(gone, docs["doc_id"].cast("long") == gone["doc_id"], "left_anti")
    again = classes.where("n_shingles > 0 and doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    again = written(again, "jaccard-again")
    if again.isEmpty():
        return kept
    rows = kept.select(F.struct("*").alias("row")).withColumn("id", F.col("row.doc_id").cast("long"))
    worded = F.coalesce(F.regexp_count("row.text", F.lit(WORD)) > 0, F.lit(False))
    several = rows.where(worded).join(again, rows["id"] == again["doc_id"], "left_semi")
    first = several.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("row.text"))).where("place = 1")
    others = rows.where(worded).join(again, rows["id"] == again["doc_id"], "left_anti").unionByName(rows.where(~worded))
    return others.select("row").unionByName(first.select("row")).select("row.*")
