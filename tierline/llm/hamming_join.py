"""Near-duplicates by a multi-index Hamming join over b-bit MinHash signatures.

A text's signature has ``CHUNKS * SLOTS`` slots; each keeps the low 16 bits of one minimum over its shingles. Two
signatures that differ in at most CHUNKS * (ERRORS + 1) - 1 slots have, by the pigeonhole principle, a chunk that
differs in at most ERRORS = 1 slots; so each chunk is indexed once for each slot it may be wrong in, with that slot
left out, and every pair under the distance meets in at least one of CHUNKS * SLOTS buckets. A pair of similarity 0.8
differs in a fifth of the slots; it meets in no bucket with a probability below 1e-7, and in fact all pairs that meet
are confirmed on their full shingle sets.

Equal texts are one class before anything is paired. Buckets are not expanded into pairs: each member is confirmed
against the bucket's centre (its smallest id) and links are joined into components. Only where a bucket still holds
members of different components are those confirmed against each other. A bucket of at most ``SMALL`` members gives
pairs, without those whose sizes or distances to the centre (Jaccard distance is a metric: |d(c, x) - d(c, y)| <=
d(x, y)) rule a link out. Larger buckets that share members are one family; a family is dealt into blocks of ``BLOCK`` texts, and two
blocks meet in one task. Blocks within one component do not meet.

Texts travel only for pairs that are likely links. Each text has a sketch: its shingles dealt to a few places, and
their number at each. Two texts have no more common shingles than the smaller number at each place, in sum; pairs that
this rules out, most of those that meet by chance, go before texts are read. Blocks that leave many pairs meet by their
texts, in one task that counts common shingles by matrix products and gives back only links that join components. So no
link between texts that meet is lost, and a family of near copies that hang together costs a few confirmations for each
member.

Defined results: documents without words, or with a null text, have an empty set and are linked with nothing; with one
word (fewer than a shingle) the whole sequence is the one shingle. Rows with a null id take part; a component without
any id has a null component_id, and ``kept`` is false. Repeated rows are classed alike.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut_lineage, ranked, slices

CHUNKS, SLOTS, ERRORS = 10, 4, 1
WORDS = 5
#: A link: 100 * |intersection| >= PERCENT * |union|.
PERCENT = 80
#: Members of a bucket that are paired one by one, texts of a block.
SMALL, BLOCK = 64, 512
#: Bits of the bitmap of wanted texts at most, as a power of two: 32 MB.
MOST_BITS = 28
#: Words whose hashes a task remembers.
MEMO = 1 << 17
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hash of each word; words of any length, a bounded number of them remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


def shingle_set(text: str | None, k: int, memo: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's k-word shingles (A-Z lower-cased; words end at ASCII white space)."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, n)
    width = min(k, n)
    out = h[: n - width + 1]
    for j in range(1, width):
        out = _mix(out) + h[j : n - width + 1 + j]
    return np.unique(_mix(out + np.uint64(width)))


def _seeds(slots: int) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(f"slot {i}") | 1 for i in range(slots)], np.uint64)


def signature(shingles: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Low 16 bits of the minimum of each slot's hash; the hash's high bits order the shingles."""
    best = np.full(len(seeds), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        part = shingles[at : at + 4096]
        x = part[:, None] * seeds
        best = np.minimum(best, (x ^ (x >> np.uint64(29))).min(0))
    return (_mix(best) & np.uint64(0xFFFF)).astype(np.int64)


def packed(signature_: np.ndarray, chunks: int = CHUNKS) -> np.ndarray:
    """The 16-bit slots of each chunk side by side in one number."""
    out = np.zeros(chunks, np.uint64)
    for column in signature_.reshape(chunks, -1).T.astype(np.uint64):
        out = (out << np.uint64(16)) | column
    return out.view(np.int64)


def slots_apart(a: str, b: str, slots: int = SLOTS):
    """In how many slots two packed signatures differ."""

    def lanes(total, z):
        for i in range(slots):
            total = total + F.shiftrightunsigned(z, 16 * i).bitwiseAND(F.lit(0xFFFF)).cast("boolean").cast("int")
        return total

    return F.aggregate(F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)), F.lit(0), lanes)


def bucket_keys(signature_: np.ndarray, chunks: int = CHUNKS, slots: int = SLOTS) -> np.ndarray:
    """One number for each chunk and slot left out, holding the other slots in full (16 bits each)."""
    sig = signature_.reshape(chunks, slots)
    place = np.arange(chunks)
    out = []
    for left_out in range(slots):
        key = place * slots + left_out
        for j in range(slots):
            if j != left_out:
                key = (key << 16) | sig[:, j]
        out.append(key)
    return np.concatenate(out)


def sketch(shingles: np.ndarray) -> bytes | None:
    """How many shingles fall on each of a power of two of places, two to four for one place on the average.

    Two counts a byte, those of the second half of the places in the high four bits; None if a count needs more.
    """
    width = 1 << max(4, (len(shingles) >> 2).bit_length())
    counts = np.bincount((shingles & np.uint64(width - 1)).astype(np.int64), minlength=width)
    if counts.max() > 15:
        return None
    return (counts[: width // 2] | counts[width // 2 :] << 4).astype(np.uint8).tobytes()


def _counts(sketches: list[bytes], width: int) -> np.ndarray:
    """The counts of sketches of one width, a row for each, on ``width`` places."""
    packed_ = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), -1)
    counts = np.concatenate((packed_ & 15, packed_ >> 4), 1)
    return counts.reshape(len(sketches), -1, width).sum(1, dtype=np.int16)


def possible(pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs (a, b, n, m, x, y) whose sizes and sketches do not rule a link out.

    A place holds no more common shingles than the smaller of its two counts, so no link is lost; a pair without a
    sketch stays.
    """

    def ask(batches):
        for batch in batches:
            n, m = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            x, y = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            most = np.minimum(n, m)
            widths = np.array([(2 * len(p or b""), 2 * len(q or b"")) for p, q in zip(x, y, strict=True)], np.int64).reshape(-1, 2)
            for v, w in np.unique(widths, axis=0).tolist():
                if v and w:
                    at = np.flatnonzero((widths == (v, w)).all(1))
                    both = [_counts([side[i] for i in at], min(v, w)) for side in (x, y)]
                    most[at] = np.minimum(*both).sum(1, dtype=np.int64)
            keep = pa.array((100 + percent) * most >= percent * (n + m))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(keep)

    return pairs.select("a", "b", "n", "m", "x", "y").mapInArrow(ask, "a long, b long")


def possible_between(sizes: np.ndarray, sketches: list[bytes | None], components_: np.ndarray, left: int | None, percent: int) -> list[tuple[int, int]]:
    """Pairs (i, j) of different components whose sizes and sketches do not rule a link out; ``left`` as in :func:`links_between`."""
    cut, first = (len(sizes), 0) if left is None else (left, left)
    n, m = sizes[:cut, None], sizes[None, first:]
    open_ = components_[:cut, None] != components_[None, first:]
    if left is None:
        open_ = np.triu(open_, 1)
    most = np.minimum(n, m) + np.zeros_like(open_, np.int64)
    widths = np.array([2 * len(x or b"") for x in sketches], np.int64)
    open_ &= (100 + percent) * most >= percent * (n + m)
    for v in np.unique(widths[:cut]).tolist():
        for w in np.unique(widths[first:]).tolist():
            rows, cols = np.flatnonzero(widths[:cut] == v), np.flatnonzero(widths[first:] == w)
            if v and w and open_[np.ix_(rows, cols)].any():
                x = _counts([sketches[i] for i in rows], min(v, w))
                y = _counts([sketches[first + j] for j in cols], min(v, w))
                for i, of_i in zip(rows, x, strict=True):
                    some = open_[i, cols]
                    most[i, cols[some]] = np.minimum(of_i, y[some]).sum(1, dtype=np.int64)
    i, j = np.nonzero(open_ & ((100 + percent) * most >= percent * (n + m)))
    return list(zip(i.tolist(), (j + first).tolist(), strict=True))


def signatures(docs: DataFrame, k: int = WORDS, chunks: int = CHUNKS, slots: int = SLOTS) -> DataFrame:
    """(tkey, n, sig, keys, sketch): each distinct text of each task once; texts without words are left out.

    ``sig`` holds the slots of each chunk as one number.
    """
    seeds = _seeds(chunks * slots)

    def sign(batches):
        memo, seen = WordHashes(), set()
        for batch in slices(batches):
            tkeys, ns, sigs, keys, sketches = [], [], [], [], []
            for tkey, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text is None or tkey in seen:
                    continue
                seen.add(tkey)
                s = shingle_set(text, k, memo)
                if len(s):
                    tkeys.append(tkey)
                    ns.append(len(s))
                    sig = signature(s, seeds)
                    sigs.append(packed(sig, chunks))
                    keys.append(bucket_keys(sig, chunks, slots))
                    sketches.append(sketch(s))
            yield pa.RecordBatch.from_pydict(
                {
                    "tkey": pa.array(tkeys, pa.binary()),
                    "n": pa.array(ns, pa.int64()),
                    "sig": pa.array(sigs, pa.list_(pa.int64())),
                    "keys": pa.array(keys, pa.list_(pa.int64())),
                    "sketch": pa.array(sketches, pa.binary()),
                }
            )

    return docs.select(text_key(), "text").mapInArrow(sign, "tkey binary, n long, sig array<long>, keys array<long>, sketch binary")


def text_key():
    """16 bytes that name a text."""
    return F.unhex(F.md5(F.col("text").cast("binary"))).alias("tkey")


def distinct_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, text) for each (tkey, id) of ``wanted``.

    Each task drops texts that a bitmap of the wanted ones does not know, and copies, before the exchange.
    """
    wanted = cut_lineage(wanted, "wanted")
    size = 1 << max(18, min(MOST_BITS, (8 * wanted.count()).bit_length()))
    bit = F.pmod(F.xxhash64("tkey"), F.lit(size)).alias("bit")
    maps = wanted.select((bit + 1).alias("bit")).groupBy(F.expr("bitmap_bucket_number(bit)").alias("at"))
    table = np.zeros(size // 8, np.uint8)
    for at, part in maps.agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit))")).toLocalIterator():  # size / 8 bytes
        table[(at - 1) * len(part) : at * len(part)] = np.frombuffer(part, np.uint8)[: len(table)]
    known = docs.sparkSession.sparkContext.broadcast(table)

    def first_of_task(batches):
        seen, bits = set(), known.value
        for batch in slices(batches):
            bit = batch.column(0).to_numpy(zero_copy_only=False)
            new = []
            for i in np.flatnonzero(bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).tolist():
                tkey = batch.column(1)[i].as_py()
                if tkey not in seen:
                    seen.add(tkey)
                    new.append(i)
            yield batch.select(["tkey", "text"]).take(pa.array(new, pa.int64()))

    named = docs.select(text_key(), "text").where("tkey IS NOT NULL").select(bit, "tkey", "text")
    once = named.mapInArrow(first_of_task, "tkey binary, text string").groupBy("tkey").agg(F.first("text").alias("text"))
    return once.join(wanted, "tkey").select("id", "text")


def confirm(pairs: DataFrame, texts: DataFrame, k: int = WORDS) -> DataFrame:
    """(a, b, common, together) for each (a, b): sizes of intersection and union of the full shingle sets.

    Rows are sorted by b in each task, so the set of a centre is made once for its run of rows.
    """
    both = (
        pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
        .join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
        .sortWithinPartitions("b")
        .select("a", "b", "text_a", "text_b")
    )

    def compare(batches):
        memo, last, of_b = WordHashes(), None, None
        for batch in batches:
            a, b, ta, tb = (batch.column(i) for i in range(4))
            common, together = [], []
            for i in range(batch.num_rows):
                if (here := b[i].as_py()) != last:
                    last, of_b = here, shingle_set(tb[i].as_py(), k, memo)
                of_a = shingle_set(ta[i].as_py(), k, memo)
                n = len(np.intersect1d(of_a, of_b, assume_unique=True))
                common.append(n)
                together.append(len(of_a) + len(of_b) - n)
            yield pa.RecordBatch.from_arrays([a, b, pa.array(common, pa.int64()), pa.array(together, pa.int64())], ["a", "b", "common", "together"])

    return both.mapInArrow(compare, "a long, b long, common long, together long")


def links_between(sets: list[np.ndarray], components_: np.ndarray, left: int | None, percent: int) -> list[tuple[int, int]]:
    """Links (i, j) that join different components, as few as join all that are linked.

    With ``left`` only pairs of one of the first ``left`` sets and one of the rest are looked at. Common shingles are
    counted by matrix products over the shingles that two sets or more have, some thousand at a time.
    """
    size = np.array([len(x) for x in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), size)
    names, at, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often[at] > 1
    owner, at = owner[shared], at[shared]
    _, at = np.unique(at, return_inverse=True)
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    cut = len(sets) if left is None else left
    first = 0 if left is None else left
    common = np.zeros((cut, len(sets) - first), np.float32)
    step = 4096
    for begin in range(0, int(at[-1]) + 1 if len(at) else 0, step):
        lo, hi = np.searchsorted(at, [begin, begin + step])
        has = np.zeros((len(sets), step), np.float32)
        has[owner[lo:hi], at[lo:hi] - begin] = 1
        common += has[:cut] @ has[first:].T
    common = common.astype(np.int64)
    together = size[:cut, None] + size[None, first:] - common
    link = (100 * common >= percent * together) & (components_[:cut, None] != components_[None, first:])
    head = {c: c for c in components_.tolist()}

    def top(c):
        while head[c] != c:
            head[c] = head[head[c]]
            c = head[c]
        return c

    out = []
    for i, j in zip(*np.nonzero(link), strict=True):
        a, b = top(int(components_[i])), top(int(components_[first + j]))
        if a != b:
            head[max(a, b)] = min(a, b)
            out.append((int(i), int(first + j)))
    return out


def ids_of(*pairs: DataFrame) -> DataFrame:
    """The distinct ids of pairs (a, b)."""
    each = [p.select(F.explode(F.array("a", "b")).alias("id")) for p in pairs]
    return reduce(DataFrame.union, each).distinct()


def family_links(members: DataFrame, texts_of: Callable, k: int, percent: int, block: int = BLOCK) -> DataFrame:
    """(a, b) links between components within each family; ``members``: distinct (family, component, id, n, sketch).

    Blocks meet by their sketches; the pairs that may be links are confirmed on ``texts_of`` their ids. Only blocks that
    leave more than ``block`` such pairs meet by their texts.
    """
    # members of one component lie side by side, so blocks within one component are many
    placed = ranked(members.select("family", "component", "id"), "family", ["component", "id"])
    placed = cut_lineage(placed.withColumn("block", F.floor(F.col("rank") / block).cast("int")), "blocks")
    blocks = placed.groupBy("family", "block").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    blocks = cut_lineage(blocks, "block-list")
    other = blocks.select("family", F.col("block").alias("block_b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"))
    meet = cut_lineage(
        blocks.join(other, "family")
        .where("block <= block_b AND NOT (lo = hi AND lo_b = hi_b AND lo = lo_b)")
        .select("family", F.col("block").alias("p"), F.col("block_b").alias("q")),
        "block-pairs",
    )
    facts = members.select("id", "n", "sketch").distinct()

    def sides(meet: DataFrame) -> DataFrame:
        of = meet.select("family", "p", "q", F.explode(F.array_distinct(F.array("p", "q"))).alias("block"))
        return placed.join(of, ["family", "block"])

    def left_of(pdf: pd.DataFrame) -> int | None:
        return None if pdf["p"].iloc[0] == pdf["q"].iloc[0] else int((pdf["block"] == pdf["p"]).sum())

    def ask_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["block", "id"])
        ids = pdf["id"].to_numpy(np.int64)
        found = possible_between(pdf["n"].to_numpy(np.int64), list(pdf["sketch"]), pdf["component"].to_numpy(np.int64), left_of(pdf), percent)
        dense = len(found) > block
        a, b = ([None], [None]) if dense else ([ids[i] for i, _ in found], [ids[j] for _, j in found])
        at = {c: pdf[c].iloc[0] for c in ("family", "p", "q")}
        return pd.DataFrame(at | {"a": pd.array(a, "Int64"), "b": pd.array(b, "Int64")}, index=range(len(a)))

    def meet_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["block", "id"])
        memo = WordHashes()
        sets = [shingle_set(t, k, memo) for t in pdf["text"]]
        ids = pdf["id"].to_numpy(np.int64)
        found = links_between(sets, pdf["component"].to_numpy(np.int64), left_of(pdf), percent)
        return pd.DataFrame([(ids[i], ids[j]) for i, j in found], columns=["a", "b"]).astype("int64")

    asked = sides(meet).join(facts, "id").groupBy("family", "p", "q")
    asked = cut_lineage(asked.applyInPandas(ask_blocks, "family long, p int, q int, a long, b long"), "asked-blocks")
    pairs = asked.where("a IS NOT NULL").select("a", "b").distinct()
    dense = sides(asked.where("a IS NULL").select("family", "p", "q"))
    texts = texts_of(ids_of(pairs).union(dense.select("id")).distinct())
    found = confirm(pairs, texts, k).where(f"100 * common >= {percent} * together").select("a", "b")
    met = dense.join(texts, "id").groupBy("family", "p", "q").applyInPandas(meet_blocks, "a long, b long")
    return found.unionByName(met)


def near_duplicates(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, chunks: int = CHUNKS, slots: int = SLOTS) -> DataFrame:
    """(tkey, n_shingles, component, component_id) for each distinct text with words of ``docs`` (doc_id, text).

    ``component_id`` is the smallest doc_id of all rows whose texts are linked, over any number of links.
    """
    signed = signatures(docs, k, chunks, slots).drop("sig").dropDuplicates(["tkey"]).withColumn("id", F.monotonically_increasing_id())
    classes = cut_lineage(signed, "classes")  # ids are drawn once, as the table is written
    keys = classes.select("id", "n", F.explode("keys").alias("key"))
    centres = keys.groupBy("key").agg(F.min("id").alias("centre"), F.count("*").alias("members")).where("members > 1")
    buckets = cut_lineage(keys.join(centres, "key").select("key", "id", "n", "centre", "members"), "buckets")
    can_link = f"100 * least(n, m) >= {percent} * greatest(n, m)"  # sizes too far apart for any link
    sizes = classes.select(F.col("id").alias("b"), F.col("n").alias("m"))
    star = buckets.where("id != centre").select(F.col("id").alias("a"), F.col("centre").alias("b"), "n").distinct()
    facts = classes.select("id", "n", "sketch")
    star = star.join(sizes, "b").where(can_link).join(facts.select(F.col("id").alias("a"), F.col("sketch").alias("x")), "a")
    star = cut_lineage(possible(star.join(facts.select(F.col("id").alias("b"), F.col("sketch").alias("y")), "b"), percent), "near")

    def texts_of(ids: DataFrame) -> DataFrame:
        return cut_lineage(distinct_texts(docs, classes.select("tkey", "id").join(ids, "id")), "texts")

    confirmed = cut_lineage(confirm(star, texts_of(ids_of(star)), k), "star")
    is_link = f"100 * common >= {percent} * together"
    links = confirmed.where(is_link).select("a", "b")
    # buckets that still hold several components
    labelled = buckets.join(components(links), "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_ = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    rest = cut_lineage(labelled.join(open_.select("key"), "key"), "open")
    found = small_links(rest.where(f"members <= {SMALL}").join(facts.drop("n"), "id"), confirmed, texts_of, k, percent)
    large = rest.where(f"members > {SMALL}")
    families = components(large.where("id != centre").select(F.col("id").alias("a"), F.col("centre").alias("b")))
    members = large.select("id", "component").distinct().join(families.withColumnRenamed("component", "family"), "id").join(facts, "id")
    found = found.unionByName(family_links(cut_lineage(members, "members"), texts_of, k, percent))
    linked = components(cut_lineage(links.unionByName(found), "links"))
    smallest = docs.select("doc_id", text_key()).groupBy("tkey").agg(F.min("doc_id").alias("first"))
    labelled = classes.select("tkey", "id", "n").join(smallest, "tkey").join(linked, "id", "left").withColumn("component", F.coalesce("component", "id"))
    labelled = cut_lineage(labelled, "labelled")
    heads = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
    return labelled.join(heads, "component").select("tkey", F.col("n").alias("n_shingles"), "component", "component_id")


def small_links(rest: DataFrame, confirmed: DataFrame, texts: DataFrame | Callable, k: int, percent: int) -> DataFrame:
    """(a, b) links between components within small buckets, each pair of members confirmed once.

    ``texts`` are the texts (id, text), or a function that gives those of some ids. ``rest`` may have no sketches.
    """
    distance = confirmed.select(F.col("a").alias("id"), F.col("b").alias("centre"), (1 - F.col("common") / F.col("together")).alias("d"))
    # the centre's own distance is 0; one that sizes or sketches rule out was not measured
    left = rest.join(distance, ["id", "centre"], "left").withColumn("d", F.when(F.col("id") == F.col("centre"), 0.0).otherwise(F.col("d")))
    drawn = F.col("sketch") if "sketch" in rest.columns else F.lit(None).cast("binary")
    left = left.select("key", F.col("id").alias("a"), "n", "centre", "component", "d", drawn.alias("x"))
    left = cut_lineage(left, "small")
    right = left.select(
        "key", F.col("a").alias("b"), F.col("n").alias("m"), F.col("component").alias("other"), F.col("d").alias("e"), F.col("x").alias("y")
    )
    pairs = (
        left.join(right, "key")
        .where("a > b AND component != other AND a != centre AND b != centre")
        .where(f"100 * least(n, m) >= {percent} * greatest(n, m)")
        .where(f"d IS NULL OR e IS NULL OR abs(d - e) <= {1 - percent / 100 + 1e-9}")
    )
    pairs = possible(pairs, percent).distinct()
    if callable(texts):
        pairs = cut_lineage(pairs, "pairs")
        texts = texts(ids_of(pairs))
    return confirm(pairs, texts, k).where(f"100 * common >= {percent} * together").select("a", "b")


def classify(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text)."""
    classes = near_duplicates(docs.select("doc_id", "text"), **options)
    return (
        docs.select("doc_id", text_key())
        .join(classes, "tkey", "left")
        .select(
            "doc_id",
            F.coalesce("n_shingles", F.lit(0)).cast("long").alias("n_shingles"),
            F.when(F.col("n_shingles").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    )


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest doc_id, one of repeated rows.

    Documents without words all stay. The rows are stored with their numbers, so that every later reading, also after
    the loss of executors, sees the same ones; no column of ``docs`` is touched, whatever its name.
    """
    number = "row"
    while number in docs.columns:
        number += "_"
    rows = cut_lineage(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    classes = near_duplicates(rows.select("doc_id", "text"), **options).select("tkey", "component")
    placed = rows.select("doc_id", text_key(), F.col(number).alias("at")).join(classes, "tkey")
    placed = placed.select("component", F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "at").alias("place"))
    heads = placed.groupBy("component").agg(F.min("place").alias("head"))
    gone = placed.join(heads, "component").where("place.at != head.at").select(F.col("place.at").alias(number))
    return rows.join(gone, number, "left_anti").select(*docs.columns)
