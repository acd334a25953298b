"""Near-duplicate classes by Order MinHash.

Texts are lower-cased runs of non-blank characters. A k-mer is five words; equal
ones are told apart by how often they came before. Each of ``SKETCHES`` hash
functions takes the ``TAKEN`` occurrence-labelled k-mers of least hash and keeps
them in text order; their digest is the bucket of that sketch. So two texts meet
if they share these k-mers in the same order, which edit distance decides.

Candidates are verified: their k-mers (as a multiset) must have a Jaccard
similarity of at least 0.8, and an alignment inside a band must lead from one text
to the other. The band is as wide as 0.8 allows: a pair that has so many k-mers in
the same order never needs more edits, so only texts in another order are turned down.

Equal texts are one row from the start. In a bucket everyone is compared with its
hub, the text that meets most others over all its buckets: of near copies that is
the one they were made of, if it is there. Those that aren't in the hub's class
then are compared with the next hub, ``ROUNDS`` times. What is left over in a bucket
by then is compared with the texts there that share one of its rarest k-mers, as
linked texts must; how many of them count follows from both sizes, and a text can't
be linked at all if too many of its k-mers are its own. So a group of copies costs
its size, not its square, and no link between different texts that share a bucket
is lost.
Classes are connected components, found by rounds of least labels; a class is
named by its smallest id.

Null texts and texts without words are all equal. Texts of fewer than five words
have one k-mer, all their words. Ids are expected to be whole numbers that name
one text; rows of one id and several texts are in one class. Rows without an id
are in a class only with rows of equal text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartloom.llm.anchors import mix, word_hashes
from cartloom.llm.tables import WORD, let_go, map_texts, small
from cartloom.session import settle, shuffled, small_side

KMER = 5
SIMILARITY = (4, 5)
SKETCHES, TAKEN = 24, 4
#: Hubs that a bucket's texts are compared with before the rest is looked up by rare k-mers.
ROUNDS = 2
#: Pairs of one first text that are verified in one task.
FAN = 256
_SEEDS = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64))


def word_numbers(text: str | None) -> np.ndarray:
    """A 64-bit number for each word of the lower-cased text."""
    raw = [w.encode("utf-8", "surrogatepass") for w in WORD.findall((text or "").lower())]
    if not raw:
        return np.zeros(0, dtype=np.uint64)
    starts = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum([len(w) + 1 for w in raw], out=starts[1:])
    return word_hashes(b" ".join(raw), starts)


def kmers(numbers: np.ndarray) -> np.ndarray:
    """The hash of each run of five words; of all words if they are fewer."""
    if not len(numbers):
        return numbers
    size = min(KMER, len(numbers))
    h = mix(numbers[:len(numbers) - size + 1])
    for at in range(1, size):
        h = mix(h ^ numbers[at:at + len(h)])
    return h


def labelled(grams: np.ndarray) -> np.ndarray:
    """K-mers told apart by how many equal ones came before."""
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    place = np.arange(len(grams))
    first = np.maximum.accumulate(np.where(np.concatenate(([True], ranked[1:] != ranked[:-1])), place, 0))
    out = np.empty_like(grams)
    out[order] = mix(ranked + mix((place - first).astype(np.uint64)))
    return out


def sketch(numbers: np.ndarray) -> np.ndarray:
    """One digest per hash function of the least labelled k-mers in text order."""
    grams = labelled(kmers(numbers))
    if not len(grams):
        return np.zeros(0, dtype=np.uint64)
    taken = min(TAKEN, len(grams))
    out = []
    # All functions at once, or a few at a time for very long texts.
    for seeds in np.array_split(_SEEDS, min(SKETCHES, 1 + len(grams) // 100_000)):
        hashed = (grams[None, :] ^ seeds[:, None]) * np.uint64(0x9E3779B97F4A7C15)
        hashed ^= hashed >> np.uint64(32)
        least = np.sort(np.argpartition(hashed, taken - 1, axis=1)[:, :taken], axis=1)
        digest = np.full(len(seeds), taken, dtype=np.uint64)
        for column in grams[least].T:
            digest = mix(digest ^ column)
        out.append(digest)
    return np.concatenate(out)


def _prefix_sums(values: np.ndarray, powers: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers[:len(values)], out=out[1:])
    return out


class _Runs:
    """How long two texts agree from given places on, for many places at once, by hashes of their words' runs."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.a, self.b = mix(a), mix(b)
        self.powers = np.full(max(len(a), len(b), 1), 0x2545F4914F6CDD1D, dtype=np.uint64)
        self.powers[0] = 1
        np.multiply.accumulate(self.powers, out=self.powers)
        self.sums = _prefix_sums(self.a, self.powers), _prefix_sums(self.b, self.powers)
        self.longest = 1 << max(0, min(len(a), len(b)).bit_length() - 1)

    def length(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Words that agree from a[x] and b[y] on."""
        out = np.zeros(len(x), dtype=np.int64)
        inside = np.flatnonzero((x < len(self.a)) & (y < len(self.b)))
        some = inside[self.a[x[inside]] == self.b[y[inside]]]
        if not len(some):
            return out
        x, y, done = x[some], y[some], np.zeros(len(some), dtype=np.int64)
        in_a, in_b = self.sums
        size = self.longest
        while size:
            at = np.flatnonzero((x + done + size <= len(self.a)) & (y + done + size <= len(self.b)))
            p, q = x[at] + done[at], y[at] + done[at]
            same = (in_a[p + size] - in_a[p]) * self.powers[q] == (in_b[q + size] - in_b[q]) * self.powers[p]
            done[at[same]] += size
            size >>= 1
        out[some] = done
        return out


def edits_within(a: np.ndarray, b: np.ndarray, most: int) -> bool:
    """Does a script of at most ``most`` single insertions and deletions lead from ``a`` to ``b``?

    The greedy search by furthest reaching paths stays on the diagonals that so
    many edits can reach: the band. Only the last paths are kept.
    """
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return False
    runs = _Runs(a, b)
    never = np.int64(-1 << 40)
    # Place on diagonal k (x - y) is at k + most + 1.
    reach = np.full(2 * most + 3, never, dtype=np.int64)
    zero = np.zeros(1, dtype=np.int64)
    reach[most + 1] = runs.length(zero, zero)[0]
    for edits in range(most + 1):
        if edits:
            ks = np.arange(max(-edits, -m), min(edits, n) + 1)
            ks = ks[(ks - edits) % 2 == 0]
            at = ks + most + 1
            x = np.maximum(reach[at - 1] + 1, reach[at + 1])
            good = (x >= 0) & (x <= n) & (x - ks <= m) & (x >= ks)
            x[~good] = never
            ok = np.flatnonzero(good)
            x[ok] += runs.length(x[ok], x[ok] - ks[ok])
            reach[at] = x
        if n - m >= -edits and n - m <= edits and reach[n - m + most + 1] >= n:
            return True
    return False


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Are the two texts, by their word numbers, linked?"""
    above, below = SIMILARITY
    x, y = kmers(a), kmers(b)
    if not len(x) or not len(y):
        return len(x) == len(y)

    def enough(common: int) -> bool:
        return below * common >= above * (len(x) + len(y) - common)

    if not enough(min(len(x), len(y))):
        return False
    if not enough(len(np.intersect1d(labelled(x), labelled(y), assume_unique=True))):
        return False
    # Texts with c k-mers in the same order have c + 4 words so, and then a script of n1 + n2 - 2c edits at most.
    spoilt = (len(x) + len(y)) * (below - above) // (above + below)
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    differ = np.flatnonzero(a[len(a) - (short - head):][::-1] != b[len(b) - (short - head):][::-1])
    tail = int(differ[0]) if len(differ) else short - head
    return edits_within(a[head:len(a) - tail], b[head:len(b) - tail], spoilt)


def _sketched(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Per row: its id, a digest of its words, and its sketches."""
    def make():
        let_go()

        def rows(texts):
            for t in texts:
                numbers = word_numbers(t)
                yield hashlib.sha256(numbers.tobytes()).hexdigest(), sketch(numbers).view(np.int64).tolist()
        return rows

    return map_texts(docs.select(F.col(key).cast("long").alias("id"), F.col(text)), make, "same string, sketches array<long>", "id", text)


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The linked ones of the settled pairs (a, b); ``texts`` has (rep, text), one row a rep.

    Few pairs are broadcast to the texts, so that only texts in pairs are moved.
    A first text may have very many pairs: it is given to tasks of ``FAN`` of them.
    """
    n = pairs.count()
    shares = pairs.groupBy("a").agg(F.ceil(F.count("*") / FAN).cast("int").alias("shares"))
    dealt = pairs.join(shares, "a").withColumn("share", F.pmod(F.xxhash64("b"), F.col("shares")).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        last, own = None, None
        for batch in small(batches):
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if x != last:
                    last, own = x, word_numbers(x)
                ok.append(similar(own, word_numbers(y)))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    seconds = texts.select(F.col("rep").alias("b"), F.col("text").alias("of_b")).join(small_side(dealt.drop("shares"), n), "b")
    firsts = texts.select(F.col("rep").alias("a"), F.col("text").alias("of_a")).join(small_side(shares, n), "a")
    firsts = firsts.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    both = shuffled(seconds).join(shuffled(firsts), ["a", "share"])
    return both.select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(rep, class): the least id reachable over the edges (a, b), for all ids that have an edge."""
    both = settle(edges.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(
        edges.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct(), "links")
    labels = settle(both.groupBy(F.col("x").alias("rep")).agg(F.min("y").alias("class")).select("rep", F.least("rep", "class").alias("class")), "labels")
    while True:
        # The least label among the neighbours, and then the label of that label's own text.
        near = (both.join(labels.withColumnRenamed("rep", "y"), "y").groupBy("x").agg(F.min("class").alias("near"))
                .withColumnRenamed("x", "rep"))
        stepped = labels.join(near, "rep").select("rep", F.col("class").alias("was"), F.least("class", "near").alias("class"))
        root = stepped.select(F.col("rep").alias("class"), F.col("class").alias("root"))
        labelled_next = settle(stepped.join(root, "class").select("rep", "was", F.least("class", "root").alias("class")), "labels")
        changed = labelled_next.where(F.col("class") != F.col("was")).limit(1).count()
        labels = labelled_next.select("rep", "class")
        if not changed:
            return labels


def _rare_kmers(texts: DataFrame) -> DataFrame:
    """(rep, gram, n, own, at): each text's rarest labelled k-mers that others have too, so many that a linked text must share one.

    Rare ones, by their number of texts, come first in every text; ``own`` of its
    ``n`` k-mers are in no other text, and ``at`` counts those too. With a similarity
    of 4/5, at least 4n/5 are common, so one of any n - ceil(4n/5) + 1 is.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in small(batches):
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                grams = labelled(kmers(word_numbers(value))).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), doc)), pa.array(grams)], names=["rep", "gram"])

    above, below = SIMILARITY
    grams = texts.select("rep", "text").mapInArrow(run, "rep long, gram long")
    counted = grams.groupBy("gram").agg(F.count("*").alias("n"))
    by_text = grams.join(counted, "gram").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("n", "gram"))).alias("grams"))
    size = F.size("grams")
    needed = (size - F.ceil(size * above / below) + 1).cast("int")
    own = F.size(F.filter("grams", lambda g: g["n"] == 1))
    rare = by_text.select("rep", size.alias("n"), own.alias("own"), F.posexplode(F.slice("grams", F.lit(1), needed)).alias("at", "g"))
    return rare.where("g.n > 1").select("rep", "g.gram", "n", "own", "at")


def _labelled(frame: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """Adds ``class_<column>``, the class so far of the id in ``column``."""
    named = labels.select(F.col("rep").alias(column), F.col("class").alias(f"class_{column}"))
    return frame.join(named, column, "left").withColumn(f"class_{column}", F.coalesce(f"class_{column}", column))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the id and the ``class_id``, the smallest id of its class."""
    rows = settle(_sketched(docs, key, text), "sketched")
    # A text whose ids are all null is named by its digest, below zero, apart from all ids.
    same = settle(rows.groupBy("same").agg(F.min("id").alias("rep"), F.first("sketches").alias("sketches")).withColumn(
        "named", F.col("rep").isNotNull()).withColumn("rep", F.coalesce("rep", -F.abs(F.xxhash64("same") / 2).cast("long") - 1)), "same")
    buckets = same.where("named").select("rep", F.posexplode("sketches").alias("place", "digest")).distinct()
    crowded = buckets.groupBy("place", "digest").agg(F.count("*").alias("n")).where("n > 1")
    members = buckets.join(crowded, ["place", "digest"])
    central = members.groupBy("rep").agg(F.sum("n").alias("meets"))
    members = settle(members.drop("n").join(central, "rep"), "members")
    crowd = settle(members.select("rep").distinct(), "crowd")
    texts = docs.select(F.col(key).cast("long").alias("rep"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    texts = texts.join(small_side(crowd, crowd.count()), "rep", "left_semi").groupBy("rep").agg(F.max("text").alias("text"))
    texts = settle(texts, "texts")
    open_, first, links, labels = members, None, None, None
    for _ in range(ROUNDS):
        hubs = open_.groupBy("place", "digest").agg(F.max_by("rep", F.struct("meets", -F.col("rep"))).alias("hub"))
        # Those that aren't in their hub's class stay, to be compared with the next hub of their bucket.
        open_ = settle(open_.join(hubs, ["place", "digest"]).where("hub != rep"), "open")
        first = open_ if first is None else first
        pairs = open_.select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
        if labels is not None:
            pairs = _labelled(_labelled(pairs, labels, "a"), labels, "b").where("class_a != class_b").select("a", "b")
        found = _verified(settle(pairs, "pairs"), texts)
        links = settle(found if links is None else found.unionByName(links), "verified")
        labels = components(links)
        open_ = _labelled(_labelled(open_, labels, "hub"), labels, "rep").where("class_hub != class_rep").select("place", "digest", "rep", "meets")
    apart = _labelled(_labelled(first, labels, "hub"), labels, "rep").where("class_hub != class_rep")
    apart = settle(apart.select("place", "digest").distinct(), "apart")
    if apart.limit(1).count():
        links = settle(_rest(apart, members, texts, labels).unionByName(links), "verified")
        labels = components(links)
    final = same.join(labels, "rep", "left").select("same", F.coalesce("class", "rep").alias("class_id"))
    return rows.select("id", "same").join(final.hint("merge"), "same").select(F.col("id").alias(key), "class_id")


def _rest(apart: DataFrame, members: DataFrame, texts: DataFrame, labels: DataFrame) -> DataFrame:
    """Links between texts of different classes in the buckets ``apart``, which hold more than their first hub's class.

    The buckets may be crowded with texts that share one long passage and
    little else, so pairs are not listed by bucket: two linked texts share one
    of their rarest k-mers, which such texts don't. Of the classes that have a
    k-mer, all but the most frequent one look for the others; so neither is a
    class paired with itself.
    """
    crowd = settle(members.join(apart, ["place", "digest"], "left_semi").select("rep").distinct(), "crowd")
    own = texts.join(small_side(crowd, crowd.count()), "rep", "left_semi")
    rare = settle(_labelled(_rare_kmers(own), labels, "rep"), "rare")
    by_class = rare.groupBy("gram", "class_rep").agg(F.count("*").alias("n"))
    contested = by_class.groupBy("gram").agg(F.max_by("class_rep", F.struct("n", "class_rep")).alias("major"), F.count("*").alias("classes"))
    contested = settle(contested.where("classes > 1").select("gram", "major"), "contested")
    listed = settle(rare.join(contested, "gram").withColumn("seeks", F.col("class_rep") != F.col("major")), "listed")

    def side(rows: DataFrame, to: str) -> DataFrame:
        return rows.select("gram", *(F.col(c).alias(f"{c}_{to}") for c in ("rep", "class_rep", "n", "own", "at", "seeks")))

    above, below = SIMILARITY
    # K-mers that the pair must share, by both sizes; so one of the first n - shared + 1 of each is.
    shared = f"(({above} * (n_x + n_y) + {above + below - 1}) div {above + below})"
    met = side(listed.where("seeks"), "x").hint("merge").join(side(listed, "y"), "gram").where(
        f"class_rep_x != class_rep_y AND (NOT seeks_y OR rep_x < rep_y) AND {shared} <= least(n_x - own_x, n_y - own_y) "
        f"AND at_x <= n_x - {shared} AND at_y <= n_y - {shared}"
    ).select(F.col("rep_x").alias("x"), F.col("rep_y").alias("y"))
    pairs = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return _verified(settle(pairs, "remaining"), texts)


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class, the one with the class's smallest id; all columns as they are.

    Rows of one id and equal text count as one; a row with a null id stays.
    """
    found = classes(docs, key, text)
    kept = found.where(F.col(key) == F.col("class_id")).select(key).distinct()
    first = docs.join(kept, key, "left_semi").dropDuplicates([key])
    return first.unionByName(docs.where(F.col(key).isNull()))
