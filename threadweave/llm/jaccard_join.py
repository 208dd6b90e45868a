"""N-gram Jaccard join with set-relation skipping: components of documents whose sets of word shingles are similar enough.

1. Equal sets are one set from the start (a 128-bit digest of the sorted shingles stands for it), so copies cost nothing further.
2. A set's shingles are ordered, frequent ones last (how frequent is counted over all sets' leading shingles, most frequent
   last). Similar sets share a shingle among their first n - ceil(t * n) + 1, their prefixes, which are indexed.
3. Index lists are cut into blocks of sets of one size whose shingle has one position (lists of frequent shingles: of near sizes
   and near positions). Two blocks are paired only if their sizes and positions leave room for enough overlap; all others are
   skipped without a look at their entries. Short lists give pairs of sets, which count their common prefix shingles; a
   pair with too few is dropped. Long lists give no pairs: their blocks that may be paired only say which sets must be looked at
   together.
4. Sets that hang together by candidates form groups. In a group, overlaps of one set with all others are counted
   through an inverted index. A set linked with one that has been looked up derives its overlaps from that one's, reading only
   the lists of shingles by which they differ; sets of the group's largest component needn't be looked up at all, as whatever
   they are linked with outside is found from the other side.
5. Large groups are dealt out in blocks of sets. Each block is searched by itself and with one set of the group, so that near
   copies hang together at once; then only the sets outside the group's largest component visit the other blocks.

Every link between sets of different components is looked for, so the components are exact. Words and shingles are 64-bit hashes under
a key drawn for each call; inside two sets a chance collision could change an overlap by one."""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadweave.llm.common import LOWER, SPACES, mix, slices, small, spread, text_bytes, text_of, word_hashes, words, written
from threadweave.llm.components import components

SHINGLE, PERCENT = 4, 85
#: A shingle leading in more sets than OFTEN is frequent; OFTEN is doubled until at most TELL frequent ones are left, which
#: bounds what is sent to the tasks. The order decides how much work there is, never the result.
OFTEN, TELL = 8, 1_000_000
#: Leading shingles that are counted, as a multiple of the prefix: what takes a frequent one's place has been counted too.
COUNTED = 1.6
#: Longest list whose pairs are counted; longer ones join their sets in a group. Sets in a block of a large group.
PAIRED, BLOCK = 16, 2048
#: Sets of a group whose overlaps with all others are remembered at once; the others' are counted from the index.
REMEMBERED = 256
#: Blocks of a frequent shingle's list for each doubling of size and of position.
PER_OCTAVE = 8

Key = tuple[int, int]


def shingle_hashes(word_hash: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive word hashes, in order."""
    count = max(0, len(word_hash) - n + 1)
    out = np.full(count, n, np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + word_hash[k : k + count])
    return out


def shingle_sets(column: pa.Array, n: int, key: Key) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles, ascending, and where each text's begin (one more at the end)."""
    off, data = text_bytes(column)
    data = LOWER[data]
    start, end, first = words(off, data, ~SPACES)
    hashes = word_hashes(data, start, end, key)
    count = np.diff(first)
    long = np.flatnonzero(count >= n)
    grams = shingle_hashes(hashes, n)
    sizes = count[long] - n + 1
    at = spread(first[long], sizes)
    values, doc = grams[at] if len(at) else np.zeros(0, np.uint64), np.repeat(long, sizes)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        whole = np.array([shingle_hashes(hashes[first[d] : first[d + 1]], int(count[d]))[0] for d in short], np.uint64)
        values, doc = np.concatenate((values, whole)), np.concatenate((doc, short))
    order = np.lexsort((values, doc))
    values, doc = values[order], doc[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    values, doc = values[fresh], doc[fresh]
    return values, np.searchsorted(doc, np.arange(len(off)))


def digests(values: np.ndarray, bounds: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """A 128-bit digest of each set, and its first half as a number, which stands for the set where candidates are looked for
    (should two halves be equal, a group of candidates is larger than it need be)."""
    out = [hashlib.blake2b(values[a:b].tobytes(), digest_size=16).digest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
    return out, np.frombuffer(b"".join(out), "<i8")[0::2]


def prefix_size(n: np.ndarray, percent: int) -> np.ndarray:
    return n + (-percent * n // 100) + 1


def leading(values: np.ndarray, bounds: np.ndarray, percent: int, often: tuple[np.ndarray, np.ndarray] | None = None, more: float = 1.0):
    """Set number, place and value of the prefix shingles of each set (`more` times as many), and whether they are frequent."""
    n = np.diff(bounds)
    doc = np.repeat(np.arange(len(n)), n)
    frequent = np.zeros(len(values), bool)
    if often is not None and len(often[0]) and len(values):
        k = np.minimum(np.searchsorted(often[0], values), len(often[0]) - 1)
        frequent = often[0][k] == values
        order = np.lexsort((values, np.where(frequent, often[1][k], 0), doc))
        values, frequent = values[order], frequent[order]
    place = np.arange(len(values)) - np.repeat(bounds[:-1], n)
    keep = place < np.repeat(np.ceil(prefix_size(n, percent) * more), n)
    return doc[keep], place[keep], values[keep], frequent[keep]


def unseen(digest: list[bytes], seen: set[bytes]) -> np.ndarray:
    """Flags for the digests that the task meets for the first time."""
    return np.array([not (d in seen or seen.add(d)) for d in digest], bool)


def described(n: int, percent: int, key: Key):
    """Rows of two kinds: doc_id, size, digest, half of each text; shingle, c: in how many of the task's sets a shingle leads."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for part in slices(batch):
                values, bounds = shingle_sets(part.column("text"), n, key)
                (digest, half), size = digests(values, bounds), np.diff(bounds)
                yield table(doc_id=part.column("doc_id"), size=pa.array(size, pa.int64()), digest=pa.array(digest, pa.binary()), half=pa.array(half))
                new = unseen(digest, seen)
                doc, _, lead, _ = leading(values, bounds, percent, more=COUNTED)
                shingle, c = np.unique(lead[new[doc]], return_counts=True)
                yield table(shingle=pa.array(shingle.view(np.int64)), c=pa.array(c.astype(np.int64)))

    return describe


KINDS = {"doc_id": pa.int64(), "size": pa.int64(), "digest": pa.binary(), "half": pa.int64(), "shingle": pa.int64(), "c": pa.int64()}


def table(**columns: pa.Array) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_pydict({k: columns[k] if k in columns else pa.nulls(n, t) for k, t in KINDS.items()})


def indexed(n: int, percent: int, often, key: Key):
    """Index entries of each set that the task meets: shingle, half, size, place; frequent shingles as `f`."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for part in slices(batch):
                values, bounds = shingle_sets(part.column("text"), n, key)
                (digest, half), size = digests(values, bounds), np.diff(bounds)
                new = unseen(digest, seen)
                doc, place, lead, frequent = leading(values, bounds, percent, often.value)
                keep = new[doc]
                doc = doc[keep]
                yield pa.RecordBatch.from_pydict({"shingle": pa.array(lead[keep].view(np.int64)), "half": pa.array(half[doc]), "size": pa.array(size[doc].astype(np.int32)), "place": pa.array(place[keep].astype(np.int32)), "f": pa.array(frequent[keep])})

    return index


def may_pair(x: np.ndarray, y: np.ndarray, lists: dict[str, np.ndarray], percent: int) -> np.ndarray:
    """Whether sets of block x and block y, which starts at no smaller a size, may be similar, from the blocks' ranges of size
    and of the place of the shingle that they share."""
    small_x, large_x, small_y, large_y = lists["size"][x], lists["size_to"][x], lists["size"][y], lists["size_to"][y]
    need = -(-percent * (small_x + small_y) // (100 + percent))
    room = np.minimum(large_x - lists["place"][x], large_y - lists["place"][y]) + np.minimum(lists["place_to"][x], lists["place_to"][y])
    return (100 * large_x >= percent * small_y) & (room >= need)


def block_pairs(lists: dict[str, np.ndarray], end: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different blocks of a list (which ends before `end`) that may hold similar sets. A block's partners are looked
    for among those of rising size, until one is too large; blocks whose positions rule it out are skipped."""
    xs, ys, x, step = [], [], np.arange(len(end)), 0
    while len(x):
        step += 1
        x = x[x + step < end[x]]
        x = x[100 * lists["size_to"][x] >= percent * lists["size"][x + step]]
        ok = may_pair(x, x + step, lists, percent)
        xs.append(x[ok])
        ys.append(x[ok] + step)
    return (np.concatenate(xs), np.concatenate(ys)) if xs else (x, x)


def closure(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest of the n numbers that each hangs together with by the pairs x, y."""
    label = np.arange(n)
    while len(x):
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def listed(percent: int, paired: int):
    """Reads index lists (rows sorted by shingle, size, place, half): pairs a < b of sets from the blocks that may be paired, with
    their sizes; or, from a list of more than `paired` rows, each set with the first one of the blocks that hang together."""

    def pairs(rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        fresh = np.ones(len(rows["shingle"]), bool)
        fresh[1:] = (rows["shingle"][1:] != rows["shingle"][:-1]) | (rows["half"][1:] != rows["half"][:-1])
        rows = {k: v[fresh] for k, v in rows.items()}
        s, d, size = rows["shingle"], rows["half"], rows["size"]
        change = np.zeros(len(s), bool)
        change[:1] = True
        for k in ("shingle", "size", "size_to", "place", "place_to"):
            change[1:] |= rows[k][1:] != rows[k][:-1]
        begin = np.flatnonzero(change)
        held = np.diff(np.append(begin, len(s)))
        lists = {k: v[begin] for k, v in rows.items()}
        head = np.flatnonzero(np.concatenate(([True], lists["shingle"][1:] != lists["shingle"][:-1]))) if len(begin) else np.zeros(0, np.int64)
        blocks = np.diff(np.append(head, len(begin)))
        end = np.repeat(head + blocks, blocks)
        length = np.repeat(np.add.reduceat(held, head), blocks) if len(head) else blocks
        x, y = block_pairs(lists, end, percent)
        long = length > paired
        # long lists: every block hangs together with itself and with those that it may be paired with
        label = closure(len(begin), x[long[x]], y[long[x]])
        entry = np.repeat(np.arange(len(begin)), held)
        far = np.flatnonzero(long[entry] & (begin[label[entry]] != np.arange(len(s))))
        out = [(d[begin[label[entry[far]]]], d[far], size[far] * 0, size[far] * 0)]
        # short lists: all pairs of the blocks' sets
        x, y = x[~long[x]], y[~long[x]]
        a = np.repeat(spread(begin[x], held[x]), np.repeat(held[y], held[x]))
        b = spread(np.repeat(begin[y], held[x]), held[np.repeat(y, held[x])])
        own = np.flatnonzero(~long[entry])
        rest = begin[entry[own]] + held[entry[own]] - own - 1  # those after it in its block
        a, b = np.concatenate((a, np.repeat(own, rest))), np.concatenate((b, spread(own + 1, rest)))
        swap = d[a] > d[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        out.append((d[a], d[b], size[a], size[b]))
        a, b, na, nb = (np.concatenate(c) for c in zip(*out))
        yield pa.RecordBatch.from_pydict({"a": pa.array(a), "b": pa.array(b), "na": pa.array(na), "nb": pa.array(nb)})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        for batch in batches:
            now = {k: batch.column(k).to_numpy().astype(np.int64) for k in ("shingle", "half", "size", "size_to", "place", "place_to")}
            held = now if held is None else {k: np.concatenate((held[k], now[k])) for k in now}
            if len(held["shingle"]) < 200_000:
                continue
            cut = int(np.searchsorted(held["shingle"], held["shingle"][-1]))  # the last list may go on
            if cut:
                yield from pairs({k: v[:cut] for k, v in held.items()})
                held = {k: v[cut:] for k, v in held.items()}
        if held is not None:
            yield from pairs(held)

    return read


class Group:
    """Sets of one group, their inverted index and the components that they form. Overlaps of a set with all others come from
    the index; of a set linked with one whose overlaps are known, from those: the lists of the shingles by which the two sets
    differ are read, no others."""

    def __init__(self, nodes: list, sets: list[np.ndarray], percent: int, remembered: int = REMEMBERED) -> None:
        self.nodes, self.percent, self.remembered = nodes, percent, remembered
        self.size = np.array([len(s) for s in sets])
        values, self.code = np.unique(np.concatenate(sets), return_inverse=True)
        order = np.argsort(self.code, kind="stable")
        self.posting = np.repeat(np.arange(len(sets)), self.size)[order]
        self.begin = np.searchsorted(self.code[order], np.arange(len(values) + 1))
        self.bounds = np.concatenate(([0], np.cumsum(self.size)))
        self.comp, self.members = np.arange(len(sets)), np.ones(len(sets), np.int64)
        self.links: list[tuple] = []
        self.like: dict[int, int] = {}  # of a set, one linked with it whose overlaps are among `known`
        self.known: dict[int, np.ndarray] = {}

    def counts(self, tokens: np.ndarray) -> np.ndarray:
        tokens = tokens[self.begin[tokens + 1] - self.begin[tokens] > 1]  # a shingle of one set joins nothing
        lists = [self.posting[self.begin[t] : self.begin[t + 1]] for t in tokens]
        return np.bincount(np.concatenate(lists), minlength=len(self.size)) if lists else np.zeros(len(self.size), np.int64)

    def tokens(self, x: int) -> np.ndarray:
        return self.code[self.bounds[x] : self.bounds[x + 1]]

    def overlaps(self, x: int) -> np.ndarray:
        tokens = self.tokens(x)
        if self.like.get(x) in self.known:
            other = self.tokens(self.like[x])
            more, gone = np.setdiff1d(tokens, other, assume_unique=True), np.setdiff1d(other, tokens, assume_unique=True)
            if len(more) + len(gone) < len(tokens):
                return self.known[self.like[x]] + self.counts(more) - self.counts(gone)
        return self.counts(tokens)

    def look_up(self, x: int) -> None:
        overlap = self.overlaps(x)
        hit = np.flatnonzero((overlap > 0) & (100 * overlap >= self.percent * (self.size + self.size[x] - overlap)))
        hit = hit[hit != x]
        if len(hit) and len(self.known) < self.remembered:
            self.known[x] = overlap
            self.like.update((int(y), x) for y in hit if int(y) not in self.like)
        for y in hit[self.comp[hit] != self.comp[x]]:
            if self.comp[y] != self.comp[x]:
                self.links.append((self.nodes[x], self.nodes[int(y)]))
                self.join(x, int(y))

    def join(self, x: int, y: int) -> None:
        gone, stay = sorted((self.comp[x], self.comp[y]), key=lambda c: self.members[c])
        self.members[stay] += self.members[gone]
        self.members[gone] = 0
        self.comp[self.comp == gone] = stay

    def link_all(self) -> list[tuple]:
        """Links that join the components of the sets. Sets in the component that is the largest at their turn are put off.
        Those still outside the largest one at the end are looked up then, so all that are never looked up lie in one
        component and every link between components is met."""
        largest, later = 1, []
        for x in range(len(self.size)):
            here = self.members[self.comp[x]]
            if here > 1 and here >= largest:
                later.append(x)
            else:
                self.look_up(x)
                largest = max(largest, self.members[self.comp[x]])
        home = self.members.argmax()
        for x in later:
            if self.comp[x] != home:
                self.look_up(x)
        return self.links


def linked(nodes: list, sets: list[np.ndarray], percent: int, remembered: int = REMEMBERED) -> list[tuple]:
    """Links that join the components of these sets."""
    return Group(nodes, sets, percent, remembered).link_all()


def visited(nodes: list, sets: list[np.ndarray], visits: list[bool], percent: int) -> list[tuple]:
    """Links of the visiting sets with the others, as far as they join components."""
    group = Group(nodes, sets, percent)
    for x in np.flatnonzero(visits):
        group.look_up(int(x))
    return group.links


def verified(percent: int):
    """Rows sorted by label, block, visits, digest: the links of the sets of each block. If some of its sets visit, theirs
    with the others only."""

    def emit(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in out], pa.binary()), "b": pa.array([b for _, b in out], pa.binary())})

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, sets, visits, out = None, [], [], [], []

        def close() -> None:
            if len(sets) > 1:
                out.extend(visited(nodes, sets, visits, percent) if any(visits) else linked(nodes, sets, percent))

        for batch in batches:
            lists = batch.column("shingles")
            flat, off = lists.values.to_numpy(), lists.offsets.to_numpy()
            for k, (label, block, node, guest) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("label", "block", "digest", "visits")))):
                if (label, block) != key:
                    close()
                    key, nodes, sets, visits = (label, block), [], [], []
                nodes.append(node)
                sets.append(flat[off[k] : off[k + 1]].copy())
                visits.append(guest)
            if len(out) > 50_000:
                yield emit(out)
                out = []
        close()
        yield emit(out)

    return verify


def checked(n: int, key: Key):
    """Sets of the texts, but only those whose digest is the one wanted (ids may repeat with other texts)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                values, bounds = shingle_sets(part.column("text"), n, key)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))
                same = [a == b for a, b in zip(digests(values, bounds)[0], part.column("digest").to_pylist())]
                made = pa.RecordBatch.from_pydict({"digest": part.column("digest"), "label": part.column("label"), "block": part.column("block"), "blocks": part.column("blocks"), "shingles": lists})
                yield made.filter(pa.array(same, pa.bool_()))

    return read


SETS = "digest binary, label bigint, block int, blocks int, shingles array<bigint>"


def links_of(rows: DataFrame, percent: int) -> DataFrame:
    dealt = rows.select("label", "block", "visits", "digest", "shingles").repartition("label", "block").sortWithinPartitions("label", "block", "visits", "digest")
    return dealt.mapInArrow(verified(percent), "a binary, b binary")


def links_of_large(sets: DataFrame, percent: int) -> DataFrame:
    """The links of groups of several blocks. sets: digest, label, block, blocks, shingles."""
    home = sets.select("label", "block", F.lit(False).alias("visits"), "digest", "shingles")
    pivot = sets.groupBy("label").agg(F.min(F.struct("digest", "block", "blocks", "shingles")).alias("p")).select("label", "p.*")
    apart = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    sent = pivot.select("label", F.col("block").alias("home"), apart.alias("block"), F.lit(False).alias("visits"), "digest", "shingles").where("block <> home").drop("home")
    near = written(links_of(home.unionByName(sent), percent), "links")
    hanging = components(near)
    named = sets.select("digest", "label").join(hanging.select(F.col("node").alias("digest"), F.col("label").alias("comp")), "digest", "left").select("digest", "label", F.coalesce("comp", "digest").alias("comp"))
    most = named.groupBy("label", "comp").agg(F.count("*").alias("n")).groupBy("label").agg(F.max(F.struct("n", "comp")).alias("most")).select("label", F.col("most.comp").alias("comp"))
    outside = named.join(most, ["label", "comp"], "left_anti").select("digest")
    guests = sets.join(outside, "digest").select("label", F.col("block").alias("home"), apart.alias("block"), F.lit(True).alias("visits"), "digest", "shingles").where("block <> home").drop("home")
    return near.unionByName(links_of(home.unionByName(guests), percent))


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, often: int = OFTEN, paired: int = PAIRED, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, digest of every row.

    A set holds the distinct `shingle`-word shingles of the lower-cased (A-Z) text, the whole sequence of words if there are
    fewer. Sets link when 100 * intersection >= percent * union; component_id is the smallest id reachable by links. A null or
    wordless text has an empty set, is linked with nothing and is its own component. Repeated rows each have their row; null
    ids take part and get their component's smallest id, null if there is none. An empty table gives an empty result."""
    spark, key = docs.sparkSession, (secrets.randbits(64), secrets.randbits(64))
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))
    kinds = written(texts.mapInArrow(described(shingle, percent, key), "doc_id bigint, size bigint, digest binary, half bigint, shingle bigint, c bigint"), "shingle-sets")
    rows = kinds.where("digest IS NOT NULL").select("doc_id", "size", "digest", "half")
    firsts = rows.where("size > 0").groupBy("digest").agg(F.min("doc_id").alias("first"), F.min("half").alias("half"))

    counts = written(kinds.where("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("c").alias("c")).where(F.col("c") > often), "frequent")
    while counts.where(F.col("c") > often).count() > TELL:
        often *= 2
    told = counts.where(F.col("c") > often).orderBy("shingle").toPandas()
    value = told["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(value)
    sent = spark.sparkContext.broadcast((value[order], told["c"].to_numpy(np.int64)[order]))

    entries = written(texts.mapInArrow(indexed(shingle, percent, sent, key), "shingle bigint, half bigint, size int, place int, f boolean"), "index")
    pair = "a bigint, b bigint, na bigint, nb bigint"
    lists = entries.where("NOT f").select("shingle", "half", "size", F.col("size").alias("size_to"), "place", F.col("place").alias("place_to")).repartition("shingle").sortWithinPartitions("shingle", "size", "place", "half")
    found = lists.mapInArrow(listed(percent, paired), pair).groupBy("a", "b").agg(F.max("na").alias("na"), F.max("nb").alias("nb"), F.count("*").alias("common"), F.min("na").alias("grouped"))
    need = F.ceil((F.col("na") + F.col("nb")) * percent / (100 + percent))
    beyond = F.greatest(*[F.ceil(F.col(c) * percent / 100) - 1 for c in ("na", "nb")])
    near = found.where((F.col("grouped") == 0) | (F.col("common") + beyond >= need)).select("a", "b")
    # lists of frequent shingles: entries hang on their block, and blocks on those that they may be paired with. A block's name and a
    # set's half digest are of one kind of number; that they meet by chance would only enlarge a group
    octave = [F.floor(F.log2(F.col(c) + 1) * PER_OCTAVE).cast("int").alias(c + "_") for c in ("size", "place")]
    often_met = entries.where("f").select("shingle", "half", "size", "place", *octave).withColumn("name", F.xxhash64("shingle", "size_", "place_"))
    edges = (F.min("size").alias("size"), F.max("size").alias("size_to"), F.min("place").alias("place"), F.max("place").alias("place_to"))
    blocks = often_met.groupBy("shingle", F.col("name").alias("half")).agg(*edges).repartition("shingle").sortWithinPartitions("shingle", "size", "place", "half")
    hung = blocks.mapInArrow(listed(percent, 0), pair).select("a", "b")
    grouped = components(often_met.select(F.col("name").alias("a"), F.col("half").alias("b")).union(hung).union(near))

    member = grouped.join(firsts, grouped["node"] == firsts["half"]).select("digest", "label", "first")
    sizes = member.groupBy("label").agg(F.count("*").alias("n")).where("n > 1")
    member = written(member.join(sizes, "label").select("digest", "label", "first", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "groups").withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    # of rows that share an id any with the right digest will do: the set is the same
    wanted = rows.join(member.select("digest", "first"), "digest").where(F.col("doc_id").eqNullSafe(F.col("first"))).select("doc_id", "digest").distinct()
    source = texts.join(small(wanted.withColumnRenamed("doc_id", "id")), F.col("doc_id").eqNullSafe(F.col("id"))).select("text", "digest")

    def sets_of(some: DataFrame) -> DataFrame:
        return source.join(small(some.drop("first")), "digest").select("digest", "label", "block", "blocks", "text").mapInArrow(checked(shingle, key), SETS).dropDuplicates(["digest"])

    links = links_of(sets_of(member.where("blocks = 1")).withColumn("visits", F.lit(False)), percent)
    if not member.where("blocks > 1").isEmpty():
        links = links.unionByName(links_of_large(written(sets_of(member.where("blocks > 1")), "large-groups"), percent))
    joined = components(links)
    best = joined.join(firsts, joined["node"] == firsts["digest"]).groupBy("label").agg(F.min("first").alias("best"))
    named = joined.join(best, "label").select("node", "best")
    known = firsts.join(named, firsts["digest"] == named["node"], "left").select("digest", F.coalesce("best", "first").alias("component"))
    out = rows.select("doc_id", "size", "digest").join(known, "digest", "left")
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("component", F.when(F.col("size") == 0, F.col("doc_id"))).alias("component_id"), F.lower(F.hex("digest")).alias("digest"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs' rows without those that have a row of smaller id in their component; rows with an empty set all stay, and of rows
    that share the smallest id each does. Null and repeated ids, nulls, empty tables: see jaccard_components; other columns stay
    as they are."""
    keep = jaccard_components(docs, id_col=id_col, **options).where(F.col("doc_id").eqNullSafe(F.col("component_id")) | (F.col("n_shingles") == 0)).select(F.col("doc_id").alias("__tw_id")).distinct()
    return docs.join(small(keep), docs[id_col].cast("bigint").eqNullSafe(F.col("__tw_id")), "left_semi")
