"""N-gram Jaccard join by T-occurrence search.

Two documents link when their sets of k-word shingles have a Jaccard similarity of ``similarity`` or
more; so they share at least ``similarity`` of the larger set. In a fixed order of all shingles (their
hashes), the first ``lead`` of each set therefore have a stated number T of occurrences in common.

1. Equal sets are one *class* from here on, so copies cost nothing more.
2. Inverted lists of the leading shingles. A class goes on only if T of its lists hold another class.
3. Of such a class, the T - 1 longest lists are not merged (DivideSkip): a true partner has T lists
   in common and so meets it in a shorter one too. This is what keeps common passages harmless.
4. The short lists, each as a star around its smallest member, join classes into *neighbourhoods*:
   connected sets that hold both ends of any link. These are searched in blocks of bounded size: short lists are
   merged with a heap, long ones probed by binary search, and what reaches the overlap is checked on the whole sets.
5. In a neighbourhood of several blocks, steps 2 to 4 are done again with the whole sets in the lists: T is then the whole
   overlap, and short are the rarest quarter of a set's lists. Short texts around a common passage, which are more the larger
   the table is, fall apart so.
6. One that still has several blocks is first compared with a few *pivots* of its own. Those that link to pivots, mostly
   nearly all of a large group of copies, need no links among themselves any more. So only the rest meets every
   block, and the others meet only the rest's blocks: the work is that of the rest, not the square of the group. What is dealt out
   for that at once is as much as all neighbourhoods hold; if it is more, it is dealt in several turns.
7. Links give components.

Lists of a large table go through the shuffle in a few turns, of texts only those of neighbourhoods do, and scratch tables are deleted
when they have been read, so the disk in use stays under twice the table's files.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

#: Share of a set, in percent, that goes into inverted lists.
LEAD = 40
#: Classes in a block of a neighbourhood, and shingles of these; pivots; entries in a bucket of lists.
BLOCK, SHINGLES, PIVOTS, ENTRIES = 500, 1_000_000, 8, 1_000_000
#: Turns, at most, in which lists are shuffled, and buckets of lists in one at least.
TURNS, TURN_BUCKETS = 4, 16
#: Bits of a filter for each row that it lets through, and in all.
FILTER, FILTER_MOST = 16, 1 << 26
#: Shingles in neighbourhoods from which on texts are filtered: a further Python worker a task costs memory, which less text is not worth.
FILTER_LEAST = 8_000_000
#: Into how many parts the members of a large neighbourhood are dealt for joins about it.
SALT = 64
#: Documents looked at to learn which lists are very long, and how many different ones of them make a list so.
HOT_SAMPLE, HOT_LEAST = 10_000, 50
#: The length given to very long lists: above any other.
HOT = 1 << 40


def _share(n: int, percent: int) -> int:
    """percent of n, rounded up."""
    return -(-percent * n // 100)


def occurrences(n: int, percent: int, lead: int = LEAD) -> int:
    """T: leading shingles that a set of n has in common with any partner, at least.

    Let o be a pair's overlap. The leading shingles of either set hold a prefix of the common ones (by
    hash), of ceil(lead * n) - (n - o) or more. The larger set has o >= percent * n, and n less its lead
    grows with n, so for each of the two both prefixes reach (lead + percent - 100) % of its size."""
    return max(1, _share(n, lead + percent - 100))


def _class(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def _sets(frames, k: int, lead: int):
    """The shingle sets of texts: size, class and leading shingles."""
    hasher = common.WordHash()
    for frame in frames:
        rows = []
        for text in frame["text"]:
            s = common.shingle_set(common.words(text), hasher, k)
            rows.append((len(s), _class(s) if len(s) else 0, s[: _share(len(s), lead)].tobytes()))
        out = pd.DataFrame(rows, columns=["n_shingles", "class", "leading"])
        out.insert(0, "doc_id", frame["doc_id"].astype("Int64").array)
        out.insert(0, "row", frame["row"].to_numpy())
        yield out


def _frequent(frames):
    """Lengths of the lists of a sample's classes, a batch at a time."""
    for frame in frames:
        shingle, n = np.unique(_entries(frame)[0], return_counts=True)
        yield pd.DataFrame({"shingle": shingle.view(np.int64), "n": n})


def _cuts(key: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of equal keys."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    return list(zip(starts.tolist(), [*starts[1:].tolist(), len(key)], strict=False)) if len(starts) else []


def _entries(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    frame = frame.drop_duplicates("class")
    leading = [np.frombuffer(b, np.uint64) for b in frame["leading"]]
    sizes = [len(x) for x in leading]
    return np.concatenate([*leading, np.empty(0, np.uint64)]), np.repeat(frame["class"].to_numpy("int64"), sizes), np.repeat(frame["n_shingles"].to_numpy("int64"), sizes)


def _postings(frames, buckets: int, hot: np.ndarray, turns: int, turn: int):
    """Lists' entries, packed by bucket of the shingle's hash: one row a bucket and batch. Entries of
    very long lists stay out, and those of the buckets of other turns."""
    for frame in frames:
        shingle, cls, n = _entries(frame)
        bucket = (common.mix(shingle) % np.uint64(buckets)).astype(np.int64)
        own = (bucket % turns == turn) & ~np.isin(shingle, hot)
        shingle, cls, n, bucket = shingle[own], cls[own], n[own], bucket[own]
        order = np.argsort(bucket, kind="stable")
        shingle, cls, n, bucket = shingle[order], cls[order], n[order].astype(np.int32), bucket[order]
        yield pd.DataFrame([(bucket[a], shingle[a:b].tobytes(), cls[a:b].tobytes(), n[a:b].tobytes()) for a, b in _cuts(bucket)], columns=["bucket", "shingles", "classes", "ns"])


def _by_class(shingle, cls, n, length) -> pd.DataFrame:
    order = np.argsort(cls, kind="stable")
    shingle, cls, n, length = shingle[order], cls[order], n[order], length[order]
    return pd.DataFrame([(cls[a], n[a], shingle[a:b].tobytes(), length[a:b].tobytes()) for a, b in _cuts(cls)], columns=["class", "n", "shingles", "lengths"])


def _very_long(frames, hot: np.ndarray):
    """Entries of the very long lists, of which it is known that others have them too."""
    for frame in frames:
        shingle, cls, n = _entries(frame)
        at = np.isin(shingle, hot)
        yield _by_class(shingle[at], cls[at], n[at], np.full(int(at.sum()), HOT, np.int64))


def _shared(frame: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket: the lists that hold two classes or more, as each class's entries there."""
    shingle = np.concatenate([np.frombuffer(b, np.uint64) for b in frame["shingles"]])
    cls = np.concatenate([np.frombuffer(b, np.int64) for b in frame["classes"]])
    n = np.concatenate([np.frombuffer(b, np.int32) for b in frame["ns"]]).astype(np.int64)
    order = np.lexsort((cls, shingle))
    shingle, cls, n = shingle[order], cls[order], n[order]
    first = np.r_[True, (shingle[1:] != shingle[:-1]) | (cls[1:] != cls[:-1])]
    shingle, cls, n = shingle[first], cls[first], n[first]
    starts = np.flatnonzero(np.r_[True, shingle[1:] != shingle[:-1]])
    length = np.diff(np.r_[starts, len(shingle)])
    length = np.repeat(length, length).astype(np.int64)
    held = length > 1
    return _by_class(shingle[held], cls[held], n[held], length[held])


def _short(frames, percent: int, lead: int):
    """Short lists of the classes that reach T; the T - 1 longest are left out."""
    for frame in frames:
        shingles, classes = [], []
        for cls, n, parts, lengths in zip(frame["class"], frame["n"], frame["shingles"], frame["lengths"], strict=True):
            t = occurrences(n, percent, lead)
            shingle = np.concatenate([np.frombuffer(b, np.uint64) for b in parts])
            length = np.concatenate([np.frombuffer(b, np.int64) for b in lengths])
            shingle, first = np.unique(shingle, return_index=True)
            if len(shingle) < t:
                continue
            order = np.lexsort((shingle, length[first]))[: len(shingle) - (t - 1)]
            shingles.append(shingle[order].view(np.int64))
            classes.append(np.full(len(order), cls, np.int64))
        if shingles:
            yield pd.DataFrame({"shingle": np.concatenate(shingles), "class": np.concatenate(classes)})


class Index:
    """Inverted lists over a block of sets, for T-occurrence search by DivideSkip."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.owner = owner[order]
        self.tokens, self.starts = np.unique(flat[order], return_index=True)
        self.ends = np.r_[self.starts[1:], len(flat)]

    def search(self, query: np.ndarray, percent: int, skip: np.ndarray | None = None) -> list[int]:
        """Members whose similarity with the query is ``percent`` or more. ``skip``: those not asked for.

        The overlap needed is T = ceil(percent * |query| / 100) for any partner. The L longest lists are
        set aside, the rest merged; members found T - L times or more are looked up in the long ones.
        """
        at = np.searchsorted(self.tokens, query)
        at = at[(at < len(self.tokens)) & (self.tokens[np.minimum(at, len(self.tokens) - 1)] == query)] if len(self.tokens) else at[:0]
        need = -(-percent * len(query) // 100)
        if len(at) < need:
            return []
        length = self.ends[at] - self.starts[at]
        at = at[np.argsort(length, kind="stable")]
        long = min(need - 1, int(need / (1 + 0.01 * float(length.max()) * np.log2(need + 1))) if len(length) else 0)
        short = at[: len(at) - long]
        lists = [self.owner[self.starts[i] : self.ends[i]] for i in short]
        if sum(map(len, lists)) < 64:  # few entries: the heap itself
            found: dict[int, int] = {}
            for member in heapq.merge(*lists):
                found[int(member)] = found.get(int(member), 0) + 1
            members, counts = np.array(list(found), np.int64), np.array(list(found.values()), np.int64)
        else:  # the same multiway merge of sorted lists, by sorting them together
            members, counts = np.unique(np.concatenate(lists), return_counts=True)
        kept = counts >= need - long
        if skip is not None and len(members):
            kept &= ~skip[members]
        members, counts = members[kept], counts[kept]
        for i in at[len(at) - long :]:  # binary probes of the long lists
            entries = self.owner[self.starts[i] : self.ends[i]]
            where = np.minimum(np.searchsorted(entries, members), len(entries) - 1)
            counts = counts + (entries[where] == members)
        union = len(query) + self.sizes[members] - counts
        return members[100 * counts >= percent * union].tolist()


def _links(classes: np.ndarray, sets: list[np.ndarray], percent: int, homes: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning links among these sets. Members of one component, the home, are passed over: whoever is not
    in it asks for them. Another component becomes home once it is twice as large (or nobody was passed
    over yet); those passed over for the former one are then searched for, so in the end everyone outside
    the home has asked, and no link between components is left out. ``homes``: which members are in one component
    from the start."""
    index = Index(sets)
    root = np.arange(len(sets))
    size = np.ones(len(sets), np.int64)
    edges, home, passed = [], 0, []
    if homes is not None and homes.any():
        home = int(np.flatnonzero(homes)[0])
        root[homes], size[home] = home, int(homes.sum())
    left = np.argsort(-index.sizes, kind="stable")[::-1].tolist()
    while left:
        i = left.pop()
        if root[i] == root[home] and size[root[i]] > 1:
            passed.append(i)
            continue
        for j in index.search(sets[i], percent, skip=root == root[i]):
            a, b = sorted((int(root[i]), int(root[j])))
            if a != b:
                edges.append((int(classes[i]), int(classes[j])))
                root[root == b] = a
                size[a] += size[b]
                if size[a] > size[root[home]] * (2 if passed else 1):
                    left += passed
                    home, passed = a, []
    return edges


def _groups(frames, key: list[str], rest: list[str], done):
    """Rows come sorted by key; ``done`` gives the links of each group's rows."""
    last, held = None, []
    for frame in frames:
        out = []
        for k, row in zip(zip(*(frame[c].tolist() for c in key), strict=True), zip(*(frame[c].tolist() for c in rest), strict=True), strict=True):
            if k != last:
                out += done(held)
                last, held = k, []
            held.append(row)
        yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")
    yield pd.DataFrame(done(held), columns=["a", "b"]).astype("int64")


def _search(frames, percent: int):
    """Each pair of blocks of a neighbourhood by itself."""

    def done(rows: list[tuple]) -> list[tuple]:
        found = {cls: (np.frombuffer(s, np.uint64), home) for cls, s, home in rows}
        if len(found) < 2:
            return []
        return _links(np.array(list(found), np.int64), [s for s, _ in found.values()], percent, np.array([home for _, home in found.values()], bool))

    return _groups(frames, ["root", "i", "j"], ["class", "shingles", "home"], done)


def _pivots(frames, percent: int):
    """Each block of a neighbourhood against the neighbourhood's pivots."""

    def done(rows: list[tuple]) -> list[tuple]:
        pivots = {cls: np.frombuffer(s, np.uint64) for cls, s, pivot in rows if pivot}
        names, index = list(pivots), Index(list(pivots.values()))
        return [(cls, names[j]) for cls, s, pivot in rows if not pivot for j in index.search(np.frombuffer(s, np.uint64), percent) if names[j] != cls]

    return _groups(frames, ["root", "own"], ["class", "shingles", "pivot"], done)


def _whole(frames, k: int):
    hasher = common.WordHash()
    for frame in frames:
        made = [common.shingle_set(common.words(text), hasher, k) for text in frame["text"]]
        same = [len(s) > 0 and _class(s) == cls for s, cls in zip(made, frame["class"], strict=True)]
        out = frame.drop(columns=["text", "row"])
        out["shingles"] = [s.tobytes() for s in made]
        yield out[same]


def _blocks(members: DataFrame, block: int) -> DataFrame:
    """root and blocks: into how many blocks the members of each neighbourhood go, by number and by shingles."""
    return members.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / SHINGLES)).cast("int").alias("blocks"))


def _block(blocks: str) -> Column:
    return F.pmod(F.xxhash64("class", F.lit("block")), F.col(blocks)).cast("int")


def _may_be(members: DataFrame, n: int) -> Callable[[str], Column]:
    """A test of row keys, true for those of the n members and, by chance, for some others: a bit for what a key leaves when divided. Its
    size is bounded; where members are very many it only lets more others through."""
    size = 1 << min(FILTER_MOST.bit_length() - 1, max(10, (FILTER * n).bit_length()))
    at = F.pmod(F.col("row"), F.lit(size))
    found = members.groupBy((at / 64).cast("long").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(row, {size}) % 64 as int))")).alias("bits")).collect()
    bits = np.zeros(size // 64, np.uint64)
    bits[[r["word"] for r in found]] = np.array([r["bits"] for r in found], np.int64).view(np.uint64)

    @F.pandas_udf("boolean")
    def test(row: pd.Series) -> pd.Series:
        at = row.to_numpy() & (size - 1)
        return pd.Series((bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1)

    return test


def _told(members: DataFrame, about: DataFrame, on: list[str]) -> DataFrame:
    """The members (left-)joined with what is known of their large neighbourhoods. One of these may hold a third of all
    classes, so each row about it is there SALT times and its members are spread over these."""
    spread = about.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salted = members.withColumn("_salt", F.pmod(F.xxhash64("class", F.lit("salt")), F.lit(SALT)).cast("int"))
    return salted.join(spread, [*on, "_salt"], "left").drop("_salt")


def link(docs: DataFrame, similarity: int = 75, k: int = 5, lead: int = LEAD, block: int = BLOCK) -> DataFrame:
    """Near-duplicate classes: doc_id, n_shingles, component_id (smallest doc_id reachable by links).

    ``similarity`` in percent, above 100 - lead. A null or empty text, or one of white space, has no
    shingles and links with nothing; a text of fewer than k words is one shingle. Equal texts are one
    class. Every row gives a row, whatever its doc_id: if one comes twice, each row has its own text's class; rows without
    one link all the same, and name no component (null if nothing in it has a doc_id). An empty table gives an empty
    table; other columns are ignored.
    """
    sets, named = _linked(docs, similarity, k, lead, block)
    found = sets.join(named, (F.col("class") == F.col("named")) & (F.col("n_shingles") > 0), "left")
    return found.select("doc_id", "n_shingles", F.when(F.col("named").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The same columns, of one document of each class of near duplicates: that of the smallest doc_id (null last, then by
    content). Documents without shingles all stay; rows that agree in id and text are one document. Columns may have any
    names. ``options``: those of link()."""
    sets, named = _linked(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), **options)
    found = sets.where("n_shingles > 0").join(named, F.col("class") == F.col("named"))
    best = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("row").alias("c"))).alias("best")).select(F.col("best.c").alias("row"))
    row = common.fresh(docs, "_row")
    kept = best.unionByName(sets.where("n_shingles = 0").select("row")).withColumnRenamed("row", row)
    keyed = docs.withColumn(row, common.row_key(F.col(key).cast("long"), F.col(text)))
    return keyed.join(kept, row, "left_semi").dropDuplicates([row]).select(*docs.columns)


def _neighbours(lists: DataFrame, similarity: int, lead: int, name: str) -> DataFrame:
    """node, root: the neighbourhoods of classes (class, n_shingles, leading) that the first ``lead`` of their shingles leave."""
    size = lists.agg(F.sum("n_shingles").alias("n"), F.count("*").alias("docs")).first()
    buckets = TURN_BUCKETS + int((size["n"] or 0) * lead / 100 / ENTRIES)
    sample = lists.where(F.pmod(F.col("class"), F.lit(common.every(size["docs"], HOT_SAMPLE))) == 0).dropDuplicates(["class"])
    seen = sample.mapInPandas(_frequent, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_LEAST)
    hot = np.sort(np.array([r["shingle"] for r in seen.collect()], np.int64).view(np.uint64))

    entry, turns = "class long, n long, shingles binary, lengths binary", min(TURNS, buckets // TURN_BUCKETS)
    cold = [lists.mapInPandas(lambda f, turn=turn: _postings(f, buckets, hot, turns, turn), "bucket long, shingles binary, classes binary, ns binary").groupBy("bucket").applyInPandas(_shared, entry) for turn in range(turns)]
    cold = [common.materialize(x, "lists") for x in cold] if turns > 1 else cold
    gathered = lists.mapInPandas(lambda f: _very_long(f, hot), entry).distinct()
    for part in cold:
        gathered = gathered.unionByName(part)
    gathered = gathered.groupBy("class").agg(F.first("n").alias("n"), F.collect_list("shingles").alias("shingles"), F.collect_list("lengths").alias("lengths"))
    short = common.materialize(gathered.mapInPandas(lambda f: _short(f, similarity, lead), "shingle long, class long"), "short")
    if turns > 1:
        common.discard(*cold)
    stars = short.groupBy("shingle").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high")
    near = components(short.join(stars, "shingle").select(F.col("class").alias("a"), F.col("low").alias("b")).distinct(), name)
    common.discard(short)
    return near


def _linked(docs: DataFrame, similarity: int = 75, k: int = 5, lead: int = LEAD, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Rows (row, doc_id, n_shingles, class), and the component of every class (named, component, component_id)."""
    docs = common.with_text(docs).withColumn("row", common.row_key(F.col("doc_id"), F.col("text")))
    lists = common.materialize(docs.mapInPandas(lambda f: _sets(f, k, lead), "row long, doc_id long, n_shingles long, class long, leading binary"), "sets")
    sets = common.materialize(lists.drop("leading"), "rows")
    near = _neighbours(lists.where("n_shingles > 0").select("class", "n_shingles", "leading"), similarity, lead, "near")
    common.discard(lists)

    first = sets.where("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.min("row").alias("row"), F.first("n_shingles").alias("n"))
    members = near.withColumnRenamed("node", "class").join(first.select("class", "row", "n"), "class")
    members = common.materialize(_told(members, _blocks(members, block).where("blocks > 1"), ["root"]).withColumn("blocks", F.coalesce("blocks", F.lit(1))), "near")
    held = members.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("classes"), F.count_if(F.col("blocks") > 1).alias("large")).first()
    # a row that comes twice is one: its texts meet in a part of the join
    texts = docs.select("row", "text")
    texts = (texts.where(_may_be(members, held["classes"])("row")) if held["n"] >= FILTER_LEAST else texts).join(members, "row").distinct()
    whole = common.materialize(texts.mapInPandas(lambda f: _whole(f, k), "class long, root long, n long, blocks int, shingles binary"), "whole")
    scratch, started = [members, whole], None

    edges = "a long, b long"
    cell = lambda df, i, j, home: df.select("root", i.alias("i"), j.alias("j"), "class", "shingles", home.alias("home"))
    search = lambda dealt: dealt.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInPandas(lambda f: _search(f, similarity), edges)
    small, links = whole.where("blocks = 1"), []
    if held["large"]:
        # large neighbourhoods anew, by whole sets
        wide = whole.where("blocks > 1")
        finer = _neighbours(wide.select("class", F.col("n").alias("n_shingles"), F.col("shingles").alias("leading")), similarity, 100, "finer")
        again = wide.drop("root", "blocks").join(finer.withColumnRenamed("node", "class"), "class")
        again = common.materialize(_told(again, _blocks(again, block).where("blocks > 1"), ["root"]).withColumn("blocks", F.coalesce("blocks", F.lit(1))).select(*whole.columns), "finer")
        scratch.append(again)
        small = small.unionByName(again.where("blocks = 1"))

        # of what is left, pivots, dealt to every block of their own
        large = again.where("blocks > 1")
        chosen = large.groupBy("root").agg(F.max("blocks").alias("blocks"), F.slice(F.array_sort(F.collect_set(F.when(F.pmod(F.xxhash64("class"), F.col("blocks")) == 0, F.col("class")))), 1, PIVOTS).alias("classes"))
        pivots = large.join(chosen.select(F.explode("classes").alias("class")), "class").select("root", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("own"), "class", "shingles", F.lit(True).alias("pivot"))
        dealt = large.select("root", _block("blocks").alias("own"), "class", "shingles", F.lit(False).alias("pivot")).unionByName(pivots)
        started = common.materialize(dealt.repartition("root", "own").sortWithinPartitions("root", "own").mapInPandas(lambda f: _pivots(f, similarity), edges), "started")
        tags = components(started, "tags").select(F.col("node").alias("class"), F.col("root").alias("tag"))
        tagged = large.select("class", F.col("root")).join(tags, "class")
        home = tagged.groupBy("root", "tag").agg(F.count("*").alias("size")).groupBy("root").agg(F.max_by("tag", F.struct("size", "tag")).alias("home"))
        homes = _told(tagged, home, ["root"]).where("tag = home").select("class", F.lit(True).alias("home")).distinct()

        # the rest meets every block, the home meets the rest
        large = common.materialize(large.join(homes, "class", "left").withColumn("home", F.coalesce("home", F.lit(False))), "members")
        scratch += [started, large]
        rests = _blocks(large.where("not home"), block).withColumnRenamed("blocks", "rest")
        inside = _blocks(large.where("home"), block).withColumnRenamed("blocks", "inside")
        counts = rests.join(inside, "root", "full").na.fill(0)
        sized = _told(large, counts, ["root"])
        last = F.when(F.col("home"), F.col("rest")).otherwise(F.col("rest") + F.col("inside")) - 1  # none for a home without a rest
        sized = sized.select("root", "class", "n", "shingles", "home", F.when(F.col("home"), F.col("rest") + _block("inside")).otherwise(_block("rest")).alias("own"), last.alias("last"))
        met = sized.agg(F.sum(F.col("n") * (F.col("last") + 1)).alias("n")).first()["n"] or 0
        dealt = cell(sized.where("last >= 0").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last")))), F.least("own", "other"), F.greatest("own", "other"), F.col("home"))
        parts = max(1, -(-met // held["n"]))
        links = [common.materialize(search(dealt.where(F.pmod(F.xxhash64("root", "i", "j"), F.lit(parts)) == part)), "found") for part in range(parts)]
    scratch += links
    links.append(search(cell(small, F.lit(0), F.lit(0), F.lit(False))))
    if started is not None:
        links.append(started)
    found = links[0]
    for part in links[1:]:
        found = found.unionByName(part)
    roots = components(found, "links")
    common.discard(*scratch)

    joined = first.join(roots, F.col("class") == F.col("node"), "left").select("class", "doc_id", F.coalesce("root", "class").alias("root"))
    least = joined.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = joined.join(least, "root").select(F.col("class").alias("named"), F.col("root").alias("component"), "component_id")
    return sets, named


def op3_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Classes of all ``documents`` at a similarity of 75 % over 5-word shingles."""
    return link(common.table(spark, sf_dir, "documents"))
