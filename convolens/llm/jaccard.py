"""N-gram Jaccard join over a token-group matrix.

Documents with the same set of shingles are a class. Classes with the same least
shingle hash are a group, cut where it gets large; its row of the matrix is the
union of its classes' shingles. A class is a query to each group that shares one of its
prefix shingles, and opens the group only if its overlap with the group's union can
reach the similarity; only then the sets in it are compared, exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convolens.llm.components import connected_components
from convolens.llm.shared import aside, given_back, keep, small

#: Odd multipliers of the places in a shingle.
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class WordHashes(dict):
    """64-bit hashes of words, remembered for the frequent ones."""

    def __missing__(self, w: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


def mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def shingles(text: str, hashes: WordHashes, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of a whole text; a shorter text is one shingle, one without words none."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(n, len(w))
    h = np.full(len(w) - k + 1, np.uint64(k), np.uint64)
    for i in range(k):
        h += w[i : len(w) - k + 1 + i] * PLACES[i]
    return np.unique(mixed(h))


#: Shingles of a group at most, about, whatever its number of sets: what one task holds of it.
GROUP_SHINGLES = 1 << 21


def shared(n: int, percent: int) -> int:
    """How many prefix shingles a set of ``n`` has in common with any similar set: more than a passage that many texts repeat gives by itself."""
    return min(4 + n // 12, -(-percent * n // 100))


def prefix_of(tokens: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """The first few shingles in an order that is the same for all sets, frequent ones last.

    Similar sets have ``percent`` of either's shingles in common. So of all but that
    many, and k more, of each set's first shingles, k are common to both, for k up to
    what ``shared`` gives for the one with less.
    """
    size = len(tokens) - -(-percent * len(tokens) // 100) + shared(len(tokens), percent)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        often = frequent[at] == tokens
        tokens = np.concatenate([tokens[~often], tokens[often]])
    return tokens[:size]


def frequent_shingles(docs: DataFrame, one_in: int = 16, least: int = 3, most: int = 1 << 20) -> np.ndarray:
    """Hashes seen in ``least`` or more of a sample of documents. They only order the prefixes: any list gives the same links."""
    some = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(one_in)) == 0).select("text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for b in batches:
            for t in b.text:
                yield pd.DataFrame({"t": shingles(t or "", hashes).view(np.int64)})

    counts = some.mapInPandas(run, "t long").groupBy("t").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    got = counts.orderBy(F.desc("n"), "t").limit(most).select("t").toPandas()
    return np.sort(got["t"].to_numpy(np.int64).view(np.uint64))


def digests(docs: DataFrame, frequent: np.ndarray, percent: int) -> DataFrame:
    """(doc_id, mark, n, cid, gkey, prefix): set size, class, least hash and prefix shingles; a class's prefix stands with its first row in a task only."""

    @given_back
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hashes, told = WordHashes(), set()
        for texts in batches:
            n, cid, gkey, prefix = [], [], [], []
            for t in texts:
                s = shingles(t or "", hashes)
                c = xxhash.xxh3_64_intdigest(s.tobytes())
                n.append(len(s))
                cid.append(c - (1 << 64) if c >> 63 else c)
                gkey.append(int(s[:1].view(np.int64)[0]) if len(s) else 0)
                if len(s) and c not in told:
                    if len(told) > 1_000_000:
                        told.clear()
                    told.add(c)
                    prefix.append(prefix_of(s, frequent, percent).view(np.int64))
                else:
                    prefix.append(np.zeros(0, np.int64))
            yield pd.DataFrame({"n": n, "cid": cid, "gkey": gkey, "prefix": prefix})

    # ids stay on the JVM's side: a null among them would make floats of the others in a batch
    found = F.pandas_udf(run, "n long, cid long, gkey long, prefix array<long>")
    return docs.select("doc_id", "mark", found("text").alias("x")).select("doc_id", "mark", "x.*")


def group_pairs(postings: DataFrame) -> DataFrame:
    """(g1, g2, n), g1 < g2: how many prefix shingles groups share. ``postings``: (t, gid)."""

    @given_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64)] * 2
        held: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            rows = np.concatenate([np.zeros((0, 3), np.int64), *held])
            held.clear()
            order = np.lexsort((rows[:, 1], rows[:, 0]))
            rows = rows[order]
            first = np.flatnonzero(np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(1)])) if len(rows) else np.zeros(0, np.int64)
            n = np.add.reduceat(rows[:, 2], first) if len(rows) else np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(rows[first, 0]), pa.array(rows[first, 1]), pa.array(n)], ["g1", "g2", "n"])

        def pairs(t: np.ndarray, g: np.ndarray) -> Iterator[np.ndarray]:
            """Pairs of groups at each shingle, in runs of equal numbers of groups."""
            if not len(t):
                return
            fresh = np.concatenate([(t[1:] != t[:-1]) | (g[1:] != g[:-1]), [True]])
            t, g = t[fresh], g[fresh]
            start = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            width = np.diff(np.append(start, len(t)))
            for k in np.unique(width[width > 1]).tolist():
                rows = start[width == k]
                step = max(1, 2_000_000 // (k * k))
                for i in range(0, len(rows), step):
                    at = rows[i : i + step, None] + np.arange(k)
                    x, y = np.triu_indices(k, 1)
                    yield np.stack([g[at][:, x].ravel(), g[at][:, y].ravel(), np.ones(len(at) * len(x), np.int64)], 1)

        for b in batches:
            t, g = (np.concatenate([r, b.column(i).to_numpy()]) for i, r in enumerate(rest))
            last = int(np.searchsorted(t, t[-1])) if len(t) else 0  # the last shingle may go on in the next batch
            rest = [t[last:], g[last:]]
            for p in pairs(t[:last], g[:last]):
                held.append(p)
                size += len(p)
                if size > 2_000_000:
                    yield out()
                    size = 0
        held.extend(pairs(*rest))
        yield out()

    dealt = postings.repartition("t").sortWithinPartitions("t", "gid")
    return dealt.mapInArrow(run, "g1 long, g2 long, n long").groupBy("g1", "g2").agg(F.sum("n").alias("n"))


class Group:
    """Sets of one group, as an inverted list, with the union of their shingles as its keys."""

    def __init__(self, cids: list[int], sizes: list[int], sets: list[np.ndarray], percent: int):
        self.cids, self.weight, self.percent = cids, np.array(sizes, np.int64), percent
        self.n = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner = flat[order], np.repeat(np.arange(len(sets)), self.n)[order]
        self.union, self.at = np.unique(self.flat, return_index=True)
        self.at = np.append(self.at, len(self.flat))
        self.links = np.zeros(len(sets), np.int64)
        self.root: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (p := self.root.setdefault(x, x)) != x:
            self.root[x] = x = self.root[p]
        return x

    def meet(self, cid: int, weight: int, tokens: np.ndarray, inside: bool) -> int:
        """Rows of other classes that link with a query; for one that isn't of the group, its rows count for what it links with."""
        i = np.minimum(np.searchsorted(self.union, tokens), len(self.union) - 1)
        i = i[self.union[i] == tokens]
        if 100 * len(i) < self.percent * len(tokens):
            return 0  # no set in the group can be similar enough: it stays closed
        width = self.at[i + 1] - self.at[i]
        if len(self.cids) == 1:
            both = np.array([len(i)])
        else:
            ends = np.cumsum(width)
            both = np.bincount(self.owner[np.repeat(self.at[i] - ends + width, width) + np.arange(ends[-1])], minlength=len(self.cids))
        hit = np.flatnonzero(100 * both >= self.percent * (len(tokens) + self.n - both))
        total = 0
        for k in hit.tolist():
            if self.cids[k] != cid:
                total += int(self.weight[k])
                if not inside:
                    self.links[k] += weight
                a, b = self.find(cid), self.find(self.cids[k])
                if a != b:
                    self.root[max(a, b)] = min(a, b)
        return total


def open_groups(dealt: DataFrame, percent: int) -> DataFrame:
    """(cid, root, links): rows linked with each class of an opened group, and a class it is connected to.

    ``dealt``: open, salt, role (0 member, 1 query), own, cid, size, tokens, each
    (open, salt) in one partition, members first.
    """

    @given_back
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict = {"key": None}

        def finish() -> list[tuple[int, int, int]]:
            g = ready()
            if g is None:
                return []
            links = dict(state["links"])
            for c, x in zip(g.cids, g.links.tolist(), strict=True):
                links[c] = links.get(c, 0) + x
            return [(c, g.find(c), x) for c, x in links.items() if x or g.find(c) != c]

        def ready() -> Group | None:
            """The group, built when its members are all there; members that are queries of this part ask first."""
            if state["key"] is not None and state["group"] is None and state["members"]:
                m = state["members"]
                g = state["group"] = Group([x[0] for x in m], [x[1] for x in m], [x[2] for x in m], percent)
                for c, w, s, own in m:
                    if own and len(m) > 1:
                        state["links"][c] = g.meet(c, w, s, True)
            return state["group"] if state["key"] is not None else None

        for b in batches:
            out = []
            for o, salt, role, own, cid, size, tokens in zip(b.open, b.salt, b.role, b.own, b.cid, b["size"], b.tokens, strict=True):
                if (o, salt) != state["key"]:
                    out += finish()
                    state = {"key": (o, salt), "members": [], "group": None, "links": {}, "last": None}
                if (role, cid) == state["last"]:
                    continue  # the same text stands in several rows
                state["last"] = (role, cid)
                s = np.asarray(tokens, np.int64).view(np.uint64)
                if role == 0:
                    state["members"].append((cid, size, s, own))
                elif (g := ready()) is not None:
                    state["links"][cid] = state["links"].get(cid, 0) + g.meet(cid, size, s, False)
            yield pd.DataFrame(out, columns=["cid", "root", "links"])
        yield pd.DataFrame(finish() if state["key"] is not None else [], columns=["cid", "root", "links"])

    return dealt.mapInPandas(run, "cid long, root long, links long")


def linked_rows(docs: DataFrame, percent: int = 75, group_size: int = 8192, queries_a_part: int = 8192) -> DataFrame:
    """Per row: doc_id, mark (hash of the text), n, root (class that names the component, null without a set), component_id and n_links."""
    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    frequent = frequent_shingles(slim)
    digest = keep(digests(slim, frequent, percent), "digest")
    classes = keep(digest.filter("n > 0").groupBy("cid").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"), F.max("gkey").alias("gkey"), F.max("n").alias("n")), "classes")
    cuts = F.greatest(F.ceil(F.count("*") / group_size), F.ceil(F.sum("n") / GROUP_SHINGLES))
    large = classes.groupBy("gkey").agg(cuts.alias("cuts")).filter("cuts > 1")

    def with_gid(df: DataFrame) -> DataFrame:
        cut = F.coalesce(F.pmod(F.xxhash64("cid"), "cuts"), F.lit(0).cast("long"))
        return df.join(large, "gkey", "left").withColumn("gid", F.xxhash64("gkey", cut)).drop("cuts")

    grouped = keep(with_gid(classes).select("cid", "rep", "size", "gid", F.least(4 + F.floor(F.col("n") / 12), F.ceil(percent * F.col("n") / 100)).alias("least")), "groups")
    postings = with_gid(digest.filter(F.size("prefix") > 0).select("cid", "gkey", "prefix")).select(F.explode("prefix").alias("t"), "gid")
    members = grouped.groupBy("gid").agg(F.count("*").alias("k"), F.min("least").alias("least"))
    ends = [members.select(F.col("gid").alias(g), F.col("least").alias(f"least{g}"), F.col("k").alias(f"k{g}")) for g in ("g1", "g2")]
    met = group_pairs(postings).join(ends[0], "g1").join(ends[1], "g2")
    near = met.filter(F.col("n") >= F.least("leastg1", "leastg2"))
    turned = (F.col("kg1") > F.col("kg2")) | ((F.col("kg1") == F.col("kg2")) & (F.col("g1") > F.col("g2")))  # the smaller group asks the larger one
    pairs = keep(near.select(F.when(turned, F.col("g2")).otherwise(F.col("g1")).alias("g1"), F.when(turned, F.col("g1")).otherwise(F.col("g2")).alias("g2")), "pairs")
    members = members.drop("least")
    asked = pairs.join(members.select(F.col("gid").alias("g1"), F.col("k").alias("k1")), "g1").groupBy(F.col("g2").alias("gid")).agg(F.sum("k1").alias("asked"))
    opened = members.join(asked, "gid", "left").filter("k > 1 or asked is not null")
    opened = keep(opened.select("gid", F.ceil((F.coalesce("asked", F.lit(0)) + F.col("k")) / queries_a_part).cast("int").alias("salts")), "opened")
    own_salt = F.pmod(F.xxhash64("cid"), F.col("salts")).cast("int")
    as_member = grouped.join(opened, "gid").select("cid", "rep", F.explode(F.transform(F.sequence(F.lit(0), F.col("salts") - 1), lambda s: F.struct(F.col("gid").alias("open"), s.alias("salt"), F.lit(0).alias("role"), (s == own_salt).alias("own"), F.col("size").alias("size")))).alias("to"))
    as_query = grouped.join(pairs, grouped["gid"] == pairs["g1"]).select("cid", "rep", "size", "g2").join(opened, F.col("g2") == opened["gid"])
    as_query = as_query.select("cid", "rep", F.struct(F.col("g2").alias("open"), own_salt.alias("salt"), F.lit(1).alias("role"), F.lit(True).alias("own"), F.col("size").alias("size")).alias("to"))
    needed = keep(as_member.unionByName(as_query).groupBy("cid", "rep").agg(F.collect_list("to").alias("to")), "needed")
    texts = slim.join(small(needed), F.col("doc_id").eqNullSafe(F.col("rep"))).select("cid", "to", "text")

    @given_back
    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for b in batches:
            found = [shingles(t or "", hashes) for t in b.text]
            same = [xxhash.xxh3_64_intdigest(s.tobytes()) == c % (1 << 64) for s, c in zip(found, b.cid, strict=True)]
            yield pd.DataFrame({"cid": b.cid, "to": b["to"], "tokens": [s.view(np.int64) for s in found]})[same]

    kind = "array<struct<open:long,salt:int,role:int,own:boolean,size:long>>"
    tokens = texts.mapInPandas(sets, f"cid long, to {kind}, tokens array<long>")
    dealt = tokens.select("cid", F.explode("to").alias("to"), "tokens").select("to.*", "cid", "tokens").repartition("open", "salt").sortWithinPartitions("open", "salt", "role", "cid")
    met = keep(open_groups(dealt, percent), "links")

    roots = connected_components(met, "cid", "root")
    placed = roots.join(classes.select(F.col("cid").alias("node"), "rep"), "node")
    least = placed.groupBy("root").agg(F.min("rep").alias("component"))
    of_class = roots.join(least, "root").select(F.col("node").alias("n_cid"), "component", F.col("root"))
    links = met.groupBy(F.col("cid").alias("l_cid")).agg(F.sum("links").alias("links"))
    full = classes.join(of_class, F.col("cid") == F.col("n_cid"), "left").join(links, F.col("cid") == F.col("l_cid"), "left")
    full = full.select(F.col("cid").alias("c"), F.coalesce("root", "cid").alias("root"), F.coalesce("component", "rep").alias("component"), (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    out = digest.select("doc_id", "mark", "n", F.when(F.col("n") > 0, F.col("cid")).alias("cid")).join(full, F.col("cid") == F.col("c"), "left")
    return out.select("doc_id", "mark", "n", "root", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def jaccard_join(docs: DataFrame, percent: int = 75, group_size: int = 8192, queries_a_part: int = 8192) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (least doc_id reachable), n_links (other rows that link with it).

    Two rows link when 100 * |intersection| >= percent * |union| of their sets of
    5-word shingles, all of the whole texts. Null and blank texts have no set and link
    with nothing. Rows with one id and several texts are nodes of their own; null ids
    are never the least. Classes and shingles are compared by 64-bit hashes.
    Other columns are not looked at; an empty table gives an empty one.
    """
    rows = linked_rows(docs, percent, group_size, queries_a_part)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")


def drop_near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """``docs`` with one row of each component: that of the least (doc_id, hash of the text), null ids last. Rows without words all stay.

    Of rows with one id and one text that of the least other columns, as JSON, stays. Columns
    of any name and type are kept; an empty table gives an empty one.
    """
    rows = keep(linked_rows(docs, percent).filter("n > 0").select("doc_id", "mark", "root"), "rows")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    first = rows.groupBy("root").agg(F.min(order).alias("first"), F.count("*").alias("rows"))
    several = first.filter("rows > 1").select(F.col("root").alias("r"), "first")
    copies = rows.join(several, F.col("root") == F.col("r")).withColumn("stays", order == F.col("first"))
    gone = keep(copies.filter(~F.col("stays")).select(F.col("doc_id").alias("__id"), F.col("mark").alias("__gone")).distinct(), "gone")
    packed, back = aside(docs, "doc_id", "text")
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    left = packed.withColumn("__mark", mark).join(small(gone), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__mark") == F.col("__gone")), "left_anti")
    if not copies.filter("stays").groupBy("root").agg(F.count("*").alias("k")).filter("k > 1").isEmpty():  # equal rows
        worded = F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
        least = F.coalesce(F.to_json("__rest"), F.lit("")) if len(docs.columns) > 2 else F.lit("")
        one = left.filter(worded).groupBy("doc_id", "__mark").agg(F.min_by(F.struct("text", "__rest"), least).alias("x"))
        left = one.select("doc_id", "x.*").unionByName(left.filter(~worded).select("doc_id", "text", "__rest"))
    return back(left)
