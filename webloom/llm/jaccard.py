"""N-gram Jaccard join: documents of equal or near-equal shingle sets, and the classes that their links make.

A grouped prefix join. Shingles have one global order, rare ones first; two sets of similarity t or more must share
a shingle of their prefixes, the first n - ceil(t n) + 1. Documents with the same prefix and set size fall into one
group; only groups enter the index of prefixes, group pairs are filtered by size and by the places at which they
hold the shingle, and what remains is expanded to sets and verified on the whole sets.

Classes, not pairs, are wanted, so pairs inside one class are not enumerated. First each group is verified against
the hub that most of its buckets name (the member with the fewest rare shingles); then, in buckets that still hold
more than one class, the members outside the hub's class are paired with all members of other classes, behind exact
filters (sizes, places, the distance of 512-bit parity sketches, which bounds the sets' difference from below, and
the number of shingles that the prefixes share, which bounds the intersection from above). Every pair that could
link two classes is thus verified or excluded by a bound.

Copies in any number make one set and cost one verification. No bucket, class or document list reaches the driver.
Members of a bucket and of a hub are dealt out in parts, so that none of them lands in one task. To verify, texts
are shuffled to the places where they are held against each other, whatever their number; sets are made there, as a
text is smaller than its hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm import words
from webloom.llm.common import Scratch, quoted, suspects

#: Shingles of known frequency, at most: the most frequent ones. They decide the order alone, never a link.
FREQUENT = 1 << 17
#: Members of a hub, and members of a bucket outside its main class, that one part holds, about.
PART, BUCKET_PART = 64, 256
_HELD = 1 << 21
_SKETCH = 8
_U = np.uint64


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _local_counts(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            many = n > 1
            return pa.RecordBatch.from_arrays([pa.array(_signed(h[many])), pa.array(n[many].astype(np.int64))], ["h", "n"])

        for batch in batches:
            for texts in words.in_parts(batch.column(0)):
                some = words.shingle_sets(texts, k)
                held += some
                size += sum(map(len, some))
                if size > _HELD:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return run


def frequent_shingles(df: DataFrame, text: str, k: int, own: Scratch, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, counts) of the up to ``most`` most frequent shingles, counted over all texts.

    A task counts the shingles that it meets more than once; sums over tasks follow. The cut is the least count
    that leaves no more than ``most``, so what the driver gets is bounded whatever the input.
    """
    counts = own.save(df.select(text).mapInArrow(_local_counts(k), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 3"), "counts")
    steps = counts.groupBy(F.floor(F.log2("n") * 8).alias("step")).agg(F.count("*").alias("size"), F.min("n").alias("least")).orderBy(F.desc("step")).collect()
    total, cut = 0, None
    for row in steps:
        total += row["size"]
        if total > most:
            break
        cut = row["least"]
    if cut is None:
        own.drop("counts")
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    found = counts.where(F.col("n") >= cut).toArrow()
    own.drop("counts")
    h, n = found["h"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def _features(k: int, percent: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count = shared.value
        for batch in batches:
            ids, a = batch.column(0), 0
            for texts in words.in_parts(batch.column(1)):
                n, s1, s2, g, rare, sketch, prefixes = [], [], [], [], [], [], []
                for s in words.shingle_sets(texts, k):
                    size = len(s)
                    freq = np.zeros(size, np.int64)
                    if len(known) and size:
                        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                        freq = np.where(known[at] == s, count[at], 0)
                    order = np.argsort(freq, kind="stable")
                    p = s[order[: size - (percent * size + 99) // 100 + 1]] if size else s
                    n.append(size)
                    s1.append(int(words.mix(s).sum(dtype=np.uint64)) if size else 0)
                    s2.append(int((words.mix(s ^ _U(0xA5A5A5A5A5A5A5A5)) * _U(3)).sum(dtype=np.uint64)) if size else 0)
                    g.append(int(words.mix(words.mix(p ^ _U(0x5851F42D4C957F2D)).sum(dtype=np.uint64)[None] + _U(size))[0]))
                    rare.append(float((freq == 0).mean()) if size else 0.0)
                    bits = np.bincount((s & _U(64 * _SKETCH - 1)).astype(np.int64), minlength=64 * _SKETCH) & 1
                    sketch.append(np.packbits(bits.astype(np.uint8)).view(np.int64))
                    prefixes.append(p)
                bounds = np.cumsum([0, *map(len, prefixes)], dtype=np.int32)
                sk = np.stack(sketch)
                columns = [ids.slice(a, len(n)), pa.array(n, pa.int64()), *(pa.array(_signed(np.array(x, np.uint64))) for x in (s1, s2, g)), pa.array(rare), *(pa.array(np.ascontiguousarray(sk[:, j])) for j in range(_SKETCH)), pa.ListArray.from_arrays(pa.array(bounds), pa.array(_signed(np.concatenate(prefixes))))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n", "s1", "s2", "g", "rare", *(f"b{j}" for j in range(_SKETCH)), "prefix"])
                a += len(n)

    return run


_FEATURES = "id long, n long, s1 long, s2 long, g long, rare double, " + ", ".join(f"b{j} long" for j in range(_SKETCH)) + ", prefix array<long>"


def _similar_sizes(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _similar_places(n: Column, at: Column, m: Column, to: Column, percent: int) -> Column:
    """Sets of ``n`` and ``m`` that share the shingle at places ``at`` and ``to`` of the order may be similar.

    Before it they share no more than the lesser place, after it no more than the lesser rest.
    """
    most = F.least(at, to) + 1 + F.least(n - at - 1, m - to - 1)
    return (100 + percent) * most >= percent * (n + m)


def _verify(k: int, percent: int):
    """Rows (hub, part, member, node, s1, text) ordered by (hub, part, member): the hub comes first, then members.

    A text that isn't the node's set (its id came with several texts) goes; a hub of several sets has them all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        own: list[np.ndarray] = []
        for batch in batches:
            rows = zip(*(batch.column(j).to_pylist() for j in range(5)), strict=True)
            a, b = [], []
            for texts in words.in_parts(batch.column(5), 64):
                for s in words.shingle_sets(texts, k):
                    hub, part, member, node, s1 = next(rows)
                    if not len(s) or int(words.mix(s).sum(dtype=np.uint64).astype(np.int64)) != s1:
                        continue
                    if not member:
                        own = [*own, s] if key == (hub, part) else [s]
                        key = (hub, part)
                    elif key == (hub, part) and any(_similar(s, x, percent) for x in own):
                        a.append(node)
                        b.append(hub)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _similar(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    small, large = (s, t) if len(s) < len(t) else (t, s)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(s) + len(t) - both)


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the (a, b) whose sets have the similarity. Each of their texts travels once for each hub that it is held against."""
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    dealt = pairs.join(parts, "b").select(F.col("a").alias("node"), F.col("b").alias("hub"), F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"), F.lit(True).alias("member"))
    hubs = parts.select(F.col("b").alias("node"), F.col("b").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("member"))
    # A node's places go in chunks, so that a hub of many parts is no row of unbounded length.
    placed = dealt.unionByName(hubs).groupBy("node", F.floor(F.col("part") / 1024).alias("chunk")).agg(F.collect_list(F.struct("hub", "part", "member")).alias("places"))
    wanted = placed.join(nodes.select("node", "s1"), "node").select("node", "s1", "places").hint("merge")
    some = suspects(docs, F.col("id"), pairs.select("a").union(pairs.select("b")))
    rows = some.join(wanted, some["id"] == wanted["node"]).select(F.explode("places").alias("x"), "node", "s1", "text").select("x.hub", "x.part", "x.member", "node", "s1", "text")
    ordered = rows.repartition(F.col("hub"), F.col("part")).sortWithinPartitions("hub", "part", "member")
    return ordered.mapInArrow(_verify(k, percent), "a long, b long").distinct()


def components(edges: DataFrame, own: Scratch, name: str) -> DataFrame:
    """(node, label): the least node that each node of ``edges`` (a, b) reaches. Least labels with pointer jumping."""
    both = own.save(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), f"{name}-edges")
    labels = own.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), f"{name}-0")
    for step in range(1, 1000):
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("at")).agg(F.min("label").alias("near"))
        least = labels.join(near, labels["node"] == near["at"]).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        new = own.save(least.join(jump, least["label"] == jump["via"], "left").select("node", "was", F.least("label", F.coalesce("far", "label")).alias("label")), f"{name}-{step}")
        own.drop(f"{name}-{step - 1}")
        labels = new.select("node", "label")
        if new.where("label <> was").isEmpty():
            own.drop(f"{name}-edges")
            return labels
    raise RuntimeError("labels do not settle")


def jaccard_classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``df``.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, a set holds the distinct ``k``-word shingles (fewer words
    make one shingle), and two documents link when 100 * |intersection| >= ``percent`` * |union|. component_id is
    the least id that links reach, the row's own included. Null and empty texts have empty sets and link with
    nothing. Rows that share an id come back as often and are one document: if their texts differ, what links with
    one of them is linked with all. Rows of null id are left out of the links and are a class of their own
    (component_id null), and an id that is no whole number is refused with an error. Shingles are 64-bit hashes, sets are told apart by 128 bits. ``percent`` is 50 to 100. An
    empty table gives an empty one. The result reads tables of the shared scratch folder.
    """
    own = Scratch(df.sparkSession, "jaccard")
    docs = df.select(F.col(quoted(doc_id)).cast("long").alias("id"), F.col(quoted(text)).alias("text"))
    shared = df.sparkSession.sparkContext.broadcast(frequent_shingles(docs, "text", k, own))
    every = own.save(docs.mapInArrow(_features(k, percent, shared), _FEATURES), "features")
    sketch = [f"b{j}" for j in range(_SKETCH)]
    some = every.where("n > 0 AND id IS NOT NULL")
    nodes = own.save(some.groupBy("s1", "s2", "n").agg(F.min("id").alias("node"), *(F.min(c).alias(c) for c in ("g", "rare", *sketch))), "nodes")
    rows = some.select("id", "n", "s1", "s2").join(nodes.select("s1", "s2", "n", "node"), ["s1", "s2", "n"]).select("id", "n", "node")
    rows = own.save(rows.union(every.where("NOT (n > 0 AND id IS NOT NULL)").select("id", "n", F.lit(None).cast("long"))), "rows")

    # Groups: one entry per prefix and size in the index, whatever the number of documents; ``many`` if of several sets.
    least, most = (f(F.struct("s1", "s2")) for f in (F.min, F.max))
    groups = some.groupBy("g").agg(F.first("prefix").alias("prefix"), F.min("n").alias("n"), F.min(F.struct("rare", "id")).alias("rep"), F.when(least == most, 0).otherwise(1).alias("many"))
    groups = own.save(groups.select("g", "prefix", "n", "many", F.col("rep.rare").alias("rare"), F.col("rep.id").alias("rep")), "groups")
    own.drop("features")
    index = groups.select("g", "many", F.posexplode("prefix").alias("at", "h"))
    wide = own.save(index.groupBy("h").agg(F.sum(F.col("many") + 1).alias("members")).where("members > 1").select("h"), "wide")
    shared_by = suspects(index.select("h", "at", "g"), F.col("h"), wide).join(wide, "h")
    buckets = own.save(shared_by.join(groups.select("g", "many", "n", "rare", "rep"), "g").select("h", "at", "g", "many", "n", "rare", "rep"), "buckets")
    own.drop("groups", "wide")

    # The hub of each bucket, and of each group the hub that most of its buckets name.
    hubs = buckets.groupBy("h").agg(F.min(F.struct("rare", F.col("rep").alias("hub"), F.col("n").alias("hub_n"), F.col("g").alias("hub_g"), F.col("at").alias("hub_at"))).alias("x")).select("h", "x.hub", "x.hub_n", "x.hub_g", "x.hub_at")
    n, at = F.col("n"), F.col("at")
    named = (
        buckets.select("h", "at", "g", "n").join(hubs, "h")
        .where((F.col("g") != F.col("hub_g")) & _similar_sizes(n, F.col("hub_n"), percent) & _similar_places(n, at, F.col("hub_n"), F.col("hub_at"), percent))
        .groupBy("g", "hub").agg(F.count("*").alias("votes"))
        .groupBy("g").agg(F.max(F.struct("votes", (-F.col("hub")).alias("minus"))).alias("x")).select("g", (-F.col("x.minus")).alias("hub"))
    )
    inside = buckets.where("many = 1").select("g", F.col("rep").alias("hub")).distinct()
    first = own.save(nodes.select("node", "g").join(named.union(inside), "g").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct(), "pairs1")
    links = own.save(verified(docs, nodes, first, k, percent), "links1")
    # Texts of one id are one document.
    seen = rows.where("node IS NOT NULL").select("id", "node").distinct()
    low = seen.groupBy("id").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("id", "low")
    same = seen.join(low, "id").select(F.col("node").alias("a"), F.col("low").alias("b"))
    links = links.union(same)

    # What may still link two classes: members outside their hub's class, against all of another class.
    label = components(links, own, "labels")
    member = buckets.select("h", "at", "g").join(nodes.select("g", "node", "n", "rare"), "g").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    member = own.save(member, "places")
    own.drop("buckets")
    mixed = member.groupBy("h").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min(F.struct("rare", "node", "label")).alias("hub")).where("low <> high").select("h", F.col("hub.label").alias("main"))
    member = own.save(member.select("h", "at", "g", "node", "n", "label").join(mixed, "h").join(nodes.select("node", "g", *sketch), ["node", "g"]), "members")
    own.drop("places")
    # Few or many of a bucket are outside its main class: they are dealt out in parts, each of which meets all others.
    parts = member.where("label <> main").groupBy("h").agg(F.ceil(F.count("*") / BUCKET_PART).cast("int").alias("parts"))
    left = member.where("label <> main").join(parts, "h").select("h", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"), *(F.col(c).alias(f"l_{c}") for c in ("at", "node", "n", "label", *sketch)))
    other = member.join(parts, "h").select(F.col("h").alias("o_h"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("o_part"), "at", "node", "n", "label", (F.col("label") != F.col("main")).alias("minor"), *sketch)
    distance = reduce(lambda x, y: x + y, (F.bit_count(F.col(b).bitwiseXOR(F.col(f"l_{b}"))) for b in sketch))
    total = n + F.col("l_n")
    # |A n B| = (total - difference) / 2, and 100 |A n B| >= percent (total - |A n B|).
    possible = (100 + percent) * (total - distance) >= 2 * percent * total
    once = (F.col("label") != F.col("l_label")) & (~F.col("minor") | (F.col("l_node") < F.col("node")))
    near = _similar_sizes(n, F.col("l_n"), percent) & _similar_places(n, at, F.col("l_n"), F.col("l_at"), percent)
    # Each bucket that two such sets share names them once, so that their count is the number of shingles that their
    # prefixes share. Whichever prefix ends first in the order shares nothing more below its end; what is left of
    # that set bounds the rest of the intersection.
    rest = F.greatest(*(F.ceil(F.col(c) * percent / 100) - 1 for c in ("n_x", "n_y")))
    less = F.col("node") < F.col("l_node")
    cross = (
        left.join(other, (F.col("h") == F.col("o_h")) & (F.col("part") == F.col("o_part")) & once & near & possible)
        .select(F.least("node", "l_node").alias("x"), F.greatest("node", "l_node").alias("y"), F.when(less, n).otherwise(F.col("l_n")).alias("n_x"), F.when(less, F.col("l_n")).otherwise(n).alias("n_y"))
        .groupBy("x", "y", "n_x", "n_y").agg(F.count("*").alias("common"))
        .where((100 + percent) * (F.col("common") + rest) >= percent * (F.col("n_x") + F.col("n_y")))
        .select(F.col("y").alias("a"), F.col("x").alias("b"))
    )
    tried = first.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    second = own.save(cross.join(tried, ["a", "b"], "left_anti"), "pairs2")
    own.drop("members", "pairs1")
    more = own.save(verified(docs, nodes, second, k, percent), "links2")
    final = components(links.union(more), own, "classes")
    own.drop("nodes", "pairs2", "links1", "links2")
    out = rows.join(final, rows["node"] == final["node"], "left").select("id", "n", F.when(rows["node"].isNull(), rows["id"]).otherwise(F.coalesce("label", rows["node"])).alias("class"))
    return out.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), F.col("class").alias("component_id"))
