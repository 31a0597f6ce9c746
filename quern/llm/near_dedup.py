"""Operator 4, MinHash near-dedup: a multi-index Hamming join on b-bit signatures, confirmed on full shingle sets.

1. A document's set holds the 64-bit hashes of its distinct shingles of ``width`` words (one shingle of all words, if
   there are fewer). Equal sets form a class, which gets a number; its row of the smallest id stands for it, told from
   other rows of that id by the hash of its text.
2. The signature has ``POSITIONS`` minima of ``BITS`` bits. Two sets of similarity 0.8 differ in about a fifth of the
   positions; ``DISTANCE`` is the threshold under which all pairs are found.
3. Positions are split into ``CHUNKS`` chunks. Two signatures that differ in at most ``DISTANCE`` < 2 * ``CHUNKS``
   positions have, by the pigeonhole principle, a chunk with at most one difference. So each chunk gives one key for
   every position that may be wrong: the chunk without that position. Such pairs share a key - none is missed. Every
   pair that shares a key is a candidate, whatever the distance of the whole signatures: full sets decide. The texts of
   the classes that share keys are written once, by class number; later steps read nothing else of the documents.
4. Pairs of a key are not listed. A key's centre is its class of most documents; of the centres of its keys every member
   meets the one that it shares most keys with. Members that are still apart from others of a key meet one member of
   each component they share keys with.
5. What is left is exact. Keys of at most ``SMALL`` members list their pairs across components. Larger keys that hold
   several components form groups; the members outside a group's largest component are its queries and meet all its
   members in blocks - a block of queries against a chunk of members is a task, which counts intersections of full sets
   as a matrix product and returns only links that join components.
6. Components come from iterated minima over confirmed links with pointer jumping; each iteration is written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import byte_texts, coded, discard, fresh, slices, written

POSITIONS, BITS, CHUNKS, DISTANCE = 64, 16, 12, 23
#: Members of a key up to which its pairs are listed; queries and members of a group that meet in one task.
SMALL, BLOCK = 12, 256
_MULTIPLY = np.random.default_rng(20240817).integers(0, 2**64, POSITIONS, dtype=np.uint64) | np.uint64(1)


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def _sets(docs: list[list[bytes]], width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each document's shingles."""
    known, codes, starts = coded(docs)
    word = np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known))[codes]
    n = len(word)
    rolled = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            rolled[: n - k] = _spread(rolled[: n - k] + word[k:] + np.uint64(k + 1)) if n > k else rolled[:0]
        out = []
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if b - a >= width:
                out.append(np.unique(rolled[a : b - width + 1]))
            elif b > a:
                out.append(np.array([xxhash.xxh64_intdigest(b" ".join(known[c] for c in codes[a:b]), seed=int(b - a))], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """``POSITIONS`` numbers of ``BITS`` bits."""
    low = np.full(POSITIONS, 2**64 - 1, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 4096):
            x = shingles[at : at + 4096, None] * _MULTIPLY
            np.minimum(low, (x ^ (x >> np.uint64(32))).min(0), out=low)
        return (_spread(low * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.uint16)


def _sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            sets = _sets([t.lower().split() for t in byte_texts(batch.column(1))], width)
            digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), "<i8").reshape(-1, 2)
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array([signature(s).astype("<u2").tobytes() if len(s) else None for s in sets], pa.binary())], ["id", "hash", "n", "d0", "d1", "sig"])

    return run


def signed(docs: DataFrame, width: int) -> DataFrame:
    """``docs``: (id, text). Per document: id, hash (of its text), n (shingles), the set's digest (d0, d1), sig (null for
    an empty set)."""
    return docs.select("id", "text", F.xxhash64("text").alias("hash")).mapInArrow(_sign(width), f"id {docs.schema[0].dataType.simpleString()}, hash long, n long, d0 long, d1 long, sig binary")


def _chunks() -> list[range]:
    edge = [round(k * POSITIONS / CHUNKS) for k in range(CHUNKS + 1)]
    return [range(a, b) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def index_keys(signatures: np.ndarray) -> np.ndarray:
    """A row of 64-bit keys for each signature: of each chunk, without each of its positions in turn."""
    s = signatures.astype(np.uint64)
    out = np.empty((len(s), POSITIONS), np.uint64)
    with np.errstate(over="ignore"):
        for c, chunk in enumerate(_chunks()):
            for wrong in chunk:
                h = np.full(len(s), (c << 32) + wrong + 1, np.uint64)
                for p in chunk:
                    if p != wrong:
                        h = _spread(h * np.uint64(0x9E3779B97F4A7C15) + s[:, p] + np.uint64(1))
                out[:, wrong] = _spread(h)
    return out


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            keys = index_keys(np.frombuffer(b"".join(part.column(1).to_pylist()), "<u2").reshape(-1, POSITIONS))
            flat = pa.array(keys.ravel().view(np.int64))
            yield pa.record_batch([part.column(0), part.column(2), pa.ListArray.from_arrays(np.arange(0, keys.size + 1, POSITIONS, dtype=np.int32), flat)], ["id", "size", "keys"])


def _confirm(width: int, percent: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        sets = dict(zip(group["id"], _sets([(t or b"").lower().split() for t in (x.encode() if isinstance(x, str) else b"" for x in group["text"])], width), strict=True))
        centre = sets.get(group["a"].iloc[0])
        rows = []
        for i, role in zip(group["id"], group["role"], strict=True):
            if role and centre is not None:
                both = len(np.intersect1d(sets[i], centre, assume_unique=True))
                rows.append((group["a"].iloc[0], i, 100 * both >= percent * (len(sets[i]) + len(centre) - both)))
        return pd.DataFrame(rows, columns=["a", "b", "linked"])

    return run


#: Members that meet their centre in one task; a centre with more is sent to as many tasks as it takes. How many such
#: centres are broadcast; more meet the pairs by a shuffled join, which Spark splits.
MEMBERS, BROADCAST = 200, 100_000


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) with ``linked``: whether 100 * intersection >= percent * union of the full sets."""
    large = written(pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).alias("parts")).filter("parts > 1"), "large")
    few = large.limit(BROADCAST + 1).count() <= BROADCAST
    salted = pairs.join(F.broadcast(large) if few else large, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).alias("part"))
    members = salted.select(F.col("b").alias("id"), "a", "part", F.lit(True).alias("role"))
    centres = salted.select(F.col("a").alias("id"), "a", "part", F.lit(False).alias("role")).distinct()
    texts = members.unionByName(centres).join(docs, "id")
    kind = pairs.schema["a"].dataType.simpleString()
    return texts.groupBy("a", "part").applyInPandas(_confirm(width, percent), f"a {kind}, b {kind}, linked boolean")


def components(links: DataFrame) -> DataFrame:
    """(id, root) for every id of the links (a, b): the smallest id reachable."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = written(both, "links")
    new = written(edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("root"), F.lit(True).alias("moved")), "roots")
    while not new.filter("moved").isEmpty():
        old, labels = new, new.select("id", "root")
        met = edges.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("m"))
        lower = labels.join(met, "id").select("id", F.least("root", "m").alias("low"), "root")
        jump = labels.select(F.col("id").alias("low"), F.col("root").alias("far"))
        new = written(lower.join(jump, "low").select("id", F.least("low", "far").alias("root"), (F.least("low", "far") != F.col("root")).alias("moved")), "roots")
        discard(old)
    discard(edges)
    return new.select("id", "root")


def classes(sign: DataFrame) -> DataFrame:
    """(d0, d1, doc, hash, sig, size, id) of each distinct set that isn't empty: the document of the smallest id stands for
    it; ``id`` is a number of the class, which holds once the table is written."""
    found = sign.filter("sig IS NOT NULL AND id IS NOT NULL").groupBy("d0", "d1").agg(F.min(F.struct("id", "hash")).alias("s"), F.first("sig").alias("sig"), F.count("*").alias("size"))
    return found.select("d0", "d1", F.col("s.id").alias("doc"), "s.hash", "sig", "size", F.monotonically_increasing_id().alias("id"))


def _matrix(width: int, percent: int):
    """Links across components between a block of queries (``role``) and a chunk of members."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        sets = _sets([(x.encode() if isinstance(x, str) else b"").lower().split() for x in group["text"]], width)
        role, ids, roots = group["role"].to_numpy(bool), group["id"].tolist(), group["root"].tolist()
        us, vs = np.flatnonzero(role), np.flatnonzero(~role)
        parent = {r: r for r in roots}

        def find(r):
            while parent[r] != r:
                parent[r] = parent[parent[r]]
                r = parent[r]
            return r

        rows = []
        if len(us) and len(vs):
            flat = np.concatenate(sets)
            owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
            code = np.unique(flat, return_inverse=True)[1]
            met = np.zeros((2, int(code.max()) + 1), bool)
            met[0, code[role[owner]]] = True
            met[1, code[~role[owner]]] = True
            common = met.all(0)
            column = np.cumsum(common) - 1
            keep = common[code]
            at, who = column[code[keep]], owner[keep]
            order = np.argsort(at, kind="stable")
            at, who = at[order], who[order]
            both = np.zeros((len(us), len(vs)), np.float32)
            place = np.empty(len(sets), np.int64)
            place[us], place[vs] = np.arange(len(us)), np.arange(len(vs))
            for low in range(0, int(common.sum()), 4096):
                i, j = np.searchsorted(at, [low, low + 4096])
                left, right = np.zeros((len(us), 4096), np.float32), np.zeros((len(vs), 4096), np.float32)
                q = role[who[i:j]]
                left[place[who[i:j][q]], at[i:j][q] - low] = 1
                right[place[who[i:j][~q]], at[i:j][~q] - low] = 1
                both += left @ right.T
            size = np.array([len(x) for x in sets], np.float64)
            linked = 100.0 * both >= percent * (size[us][:, None] + size[vs][None, :] - both)
            for u, v in zip(*np.nonzero(linked), strict=True):
                a, b = find(roots[us[u]]), find(roots[vs[v]])
                if a != b:
                    parent[b] = a
                    rows.append((ids[us[u]], ids[vs[v]]))
        return pd.DataFrame(rows, columns=["a", "b"]).astype({"a": group["id"].dtype, "b": group["id"].dtype})

    return run


def _group_links(at: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links across the components of each group of large keys. ``at``: (any, id, root), ``any`` being a key's member."""
    kind = docs.schema["id"].dataType.simpleString()
    # a member joins the smallest of its keys' members to itself and to the others: the last are the same for many
    own = at.groupBy("id").agg(F.collect_set("any").alias("of")).withColumn("a", F.array_min("of"))
    stars = own.select("a", F.col("id").alias("b")).unionByName(own.select("a", F.explode("of").alias("b"))).distinct()
    group = components(stars).withColumnRenamed("root", "grp")
    members = group.join(at.select("id", "root").distinct(), "id")
    sizes = members.groupBy("grp", "root").agg(F.count("*").alias("n")).groupBy("grp").agg(F.sum("n").alias("all"), F.max(F.struct("n", "root")).alias("top"))
    sizes = sizes.select("grp", F.col("top.root").alias("top"), F.ceil((F.col("all") - F.col("top.n")) / BLOCK).alias("blocks"), F.ceil(F.col("all") / BLOCK).alias("chunks")).filter("blocks > 0")
    placed = members.join(sizes, "grp").join(docs, "id").withColumn("h", F.xxhash64("id"))
    to_all = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    queries = placed.filter("root != top").select("grp", F.pmod("h", "blocks").alias("block"), to_all("chunks").alias("chunk"), F.lit(True).alias("role"), "id", "root", "text")
    others = placed.select("grp", to_all("blocks").alias("block"), F.pmod("h", "chunks").alias("chunk"), F.lit(False).alias("role"), "id", "root", "text")
    return queries.unionByName(others).groupBy("grp", "block", "chunk").applyInPandas(_matrix(width, percent), f"a {kind}, b {kind}")


def near_components(docs: DataFrame, width: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """``docs``: (id, text). The signed documents, and their classes (d0, d1, doc, component): ``doc`` stands for the class,
    ``component`` is the smallest id that it is linked with, itself included."""
    sign = written(signed(docs, width), "signed")
    reps = written(classes(sign), "classes")
    keys = reps.select("id", "sig", "size").mapInArrow(_keyed, "id long, size long, keys array<long>").select("id", "size", F.explode("keys").alias("key"))
    stars = keys.groupBy("key").agg(F.min(F.struct(-F.col("size"), "id")).alias("s"), F.count("*").alias("n")).filter("n > 1").select("key", F.col("s.id").alias("centre"), "n")
    # members of keys that several classes share, with the key's centre; the later steps start from here
    shared = written(keys.select("id", "key").join(stars, "key").select("key", "id", "centre", "n"), "shared")
    met = reps.join(shared.select("id").distinct(), "id", "left_semi").select("id", F.col("doc").alias("_doc"), F.col("hash").alias("_hash"))
    # a document may be repeated: one row of it
    found = docs.select(F.col("id").alias("_doc"), "text", F.xxhash64("text").alias("_hash")).join(met, ["_doc", "_hash"])
    texts = written(found.groupBy("_doc", "_hash").agg(F.first("id").alias("id"), F.first("text").alias("text")).select("id", "text"), "texts")

    def still_open(roots: DataFrame) -> DataFrame:
        """Members with their component, of the shared keys that hold several."""
        at = shared.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
        several = at.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("id").alias("any")).filter("low != high").drop("high")
        return written(at.join(several, "key").select("key", "id", "root", "low", "any", "n"), "open")

    def link(pairs: DataFrame) -> DataFrame:
        return written(confirmed(pairs.select("a", "b"), texts, width, percent).filter("linked").select("a", "b"), "links")

    def favourite(pairs: DataFrame, *by: str) -> DataFrame:
        """Of the pairs (a, b), one row for each key that they share, the centre a of most keys for each b (and ``by``)."""
        votes = pairs.groupBy("a", "b", *by).agg(F.count("*").alias("votes"))
        return votes.groupBy("b", *by).agg(F.min(F.struct(-F.col("votes"), "a")).alias("s")).select("s.a", "b").distinct()

    nearest = written(favourite(shared.filter("id != centre").select(F.col("centre").alias("a"), F.col("id").alias("b"))), "nearest")
    links = link(nearest)
    at = still_open(components(links))
    centre = at.groupBy("key").agg(F.min(F.when(F.col("root") == F.col("low"), F.struct(F.xxhash64("id"), "id"))).alias("c"))
    second = written(favourite(at.filter("root != low").join(centre, "key").select(F.col("c.id").alias("a"), F.col("id").alias("b"), "low"), "low"), "second")
    links = links.unionByName(link(written(second.join(nearest, ["a", "b"], "left_anti"), "pairs")))
    discard(at)
    at = still_open(components(links))
    few = at.filter(F.col("n") <= SMALL)
    pairs = few.join(few.select("key", F.col("id").alias("b"), F.col("root").alias("other")), "key").filter("id < b AND root != other").select(F.col("id").alias("a"), "b").distinct()
    tried = nearest.unionByName(second).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = links.unionByName(link(written(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")))
    large = at.filter(F.col("n") > SMALL)
    if not large.isEmpty():
        links = links.unionByName(written(_group_links(large, texts, width, percent), "links"))
    roots = components(links)
    discard(at, shared, texts, nearest, second)
    named = roots.join(reps.select("id", "doc"), "id")
    lowest = named.groupBy("root").agg(F.min("doc").alias("component"))
    linked = named.join(lowest, "root").select("id", "component")
    return sign, reps.join(linked, "id", "left").select("d0", "d1", "doc", F.coalesce("component", "doc").alias("component"))


def placed(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs``: (id, text). Per row: id, hash (of its text), n, component, kept."""
    sign, named = near_components(docs, width, percent)
    # two shuffled sides: Spark splits the rows of a class of very many equal documents over tasks
    stands = named.select(F.col("d0").alias("_0"), F.col("d1").alias("_1"), F.col("component").alias("_c"))
    joined = sign.join(stands, (F.col("d0") == F.col("_0")) & (F.col("d1") == F.col("_1")) & F.col("sig").isNotNull(), "left")
    component = F.coalesce("_c", "id")
    return joined.select("id", "hash", "n", component.alias("component"), F.coalesce(F.col("id") == component, component.isNull()).alias("kept"))


def report(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept.

    Documents without words (null and empty texts) are linked with nothing. Repeated rows are documents of equal sets;
    rows that repeat an id stay as many rows, and if their texts differ, each has the component of its own text, named by
    the smallest id there. A row without an id takes the component of its equals (none: null, and it is kept). Ties go to
    the smallest id. An empty table gives an empty table. Other columns are not read.
    """
    out = placed(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), width, percent)
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "kept")


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the documents of a component other than its smallest id. Rows with a null id stay; so do rows that
    repeat a kept row's id and text."""
    key, own = fresh("_key", docs.columns), fresh("_hash", docs.columns)
    found = placed(docs.select(F.col("doc_id").alias("id"), "text"), width, percent)
    gone = found.filter("NOT kept AND id IS NOT NULL").select(F.col("id").alias(key), F.col("hash").alias(own)).distinct()
    return docs.join(gone, (F.col("doc_id") == F.col(key)) & (F.xxhash64("text") == F.col(own)), "left_anti")
