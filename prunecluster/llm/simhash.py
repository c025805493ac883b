"""SimHash near-duplicates, found by decoding fingerprints with the binary Golay code.

A fingerprint of 64 bits is three segments, each padded to the 23 bits of the perfect Golay code,
whose words are decoded to the index of the codeword within three bits. If two fingerprints differ
in at most two bits, some word lies within one bit of both. So each fingerprint gets as keys the index
triples of all words within one bit of it: one segment at most has an error, the other two decode
as they are. That makes one key for the fingerprint itself and none or five more for each
segment, 16 at most; any two fingerprints within two bits share a key. Those that share one are compared.

Texts with four in five of their five-word shingles in common often differ in more bits than keys reach. Where
that share decides (``drop_near_copies``), fingerprints only name pairs to look at, texts with equal minima of
several hashes over their shingles are looked at as well, and a pair counts if its shingles say so.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prunecluster.llm.batches import doc_texts, id_and_text, map_rows, row_key, without
from prunecluster.llm.components import components
from prunecluster.storage import RunTables

#: Generator polynomial of the binary Golay code of length 23.
GOLAY, LENGTH, CHECKS = 0b110001110101, 23, 11
#: First bit and width of the segments of a fingerprint.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints under one key beyond which they go by the words within one bit instead.
HOT_KEY = 4096
#: Hashes counted at once.
HASHES = 1 << 16
#: Words of the shingles of near copies; they have FOUR in FIVE of those of both in common.
NEAR_WORDS, FOUR, FIVE = 5, 4, 5
#: Bands of minima and minima of a band: of pairs at exactly 0.8 all but (1 - 0.8^4)^20 share a band, 3 in 100,000 not.
BANDS, MINIMA = 20, 4
#: Members of a bucket up to which its pairs are looked at as they are; of larger ones, shingles that stand alone are counted.
FEW = 32
#: Bins of sizes for each factor of e, in crowded buckets.
BINS = 100
#: Hashes whose minima are taken at once.
BLOCK = 4096


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator."""
    words = words.astype(np.int64)
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        words = words ^ (((words >> bit) & 1) * (GOLAY << (bit - CHECKS)))
    return words


def error_patterns() -> np.ndarray:
    """The error of at most three bits for each of the 2^11 syndromes; the code is perfect."""
    table = np.zeros(1 << CHECKS, np.int64)
    for weight in (1, 2, 3):
        errors = np.array([sum(1 << b for b in bits) for bits in combinations(range(LENGTH), weight)])
        table[syndrome(errors)] = errors
    return table


def golay_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for each different key of each fingerprint (unsigned 64 bits)."""
    errors = error_patterns()
    index, variants = [], []
    for first, width in SEGMENTS:
        word = ((prints >> np.uint64(first)) & np.uint64((1 << width) - 1)).astype(np.int64)
        flips = np.array([0] + [1 << b for b in range(width)])
        near = word[:, None] ^ flips
        # The remainder is linear, so one per word and one per flip do for all.
        marks = syndrome(word)[:, None] ^ syndrome(flips)
        codes = (near ^ errors[marks]) >> CHECKS
        index.append(codes[:, 0])
        variants.append(codes)
    keys = []
    for s, codes in enumerate(variants):
        parts = [codes if t == s else index[t][:, None] for t in range(3)]
        keys.append((parts[0] << 24) | (parts[1] << 12) | parts[2])
    keys = np.sort(np.concatenate(keys, axis=1), axis=1)
    fresh = np.ones(keys.shape, bool)
    fresh[:, 1:] = keys[:, 1:] != keys[:, :-1]
    rows = np.nonzero(fresh)[0]
    return rows, keys[fresh]


def mixed(hashes: np.ndarray, table: int) -> np.ndarray:
    """Other hashes from hashes, those of the given table; table 0 has them as they are."""
    if not table:
        return hashes
    with np.errstate(over="ignore"):
        x = hashes + np.uint64(table) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def fingerprints(text: bytes, shingle: int = 3, seed: int = 42, tables: int = 1) -> list[int]:
    """The SimHash of a text, as an unsigned number, from each of so many tables of hashes."""
    import xxhash

    words = text.lower().split()  # of bytes: A-Z alone, and ASCII white space alone
    if not words:
        return [0] * tables
    n = max(1, len(words) - shingle + 1)
    parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else iter([b" ".join(words)])
    hashes = map(xxhash.xxh64_intdigest, parts, repeat(seed))
    counts = np.zeros((tables, 2048), np.int64)
    left = n
    while left:
        part = np.fromiter(hashes, np.uint64, min(left, HASHES))
        left -= len(part)
        for table in range(tables):
            octets = mixed(part, table).astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64) + np.arange(0, 2048, 256)
            counts[table] += np.bincount(octets.ravel(), minlength=2048)
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
    ones = (counts.reshape(tables, 8, 256) @ bits).reshape(tables, 64)
    return np.packbits(ones * 2 > n, axis=1, bitorder="little").view("<u8").ravel().tolist()


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    return fingerprints(text, shingle, seed)[0]


def _prints(documents: DataFrame, shingle: int, tables: int) -> DataFrame:
    def make(batches):
        for batch in batches:
            for (doc_id, text), key in zip(doc_texts([batch]), batch.column("row_key").to_pylist()):
                signed = [v - (1 << 64) if v >> 63 else v for v in fingerprints(text, shingle, tables=tables)]
                yield doc_id, key, signed[0], signed[1:]

    keyed = id_and_text(documents).withColumn("row_key", row_key())
    return map_rows(keyed, make, "doc_id long, row_key long, print long, more array<long>")


def _forest(prints: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links that join what is within ``most`` bits, without a circle: one fewer than nodes at most."""
    left, found = np.arange(len(prints)), []
    while len(left):
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            node = reached.pop()
            near = np.bitwise_count(prints[left] ^ prints[node]) <= most
            found.extend((int(node), int(x)) for x in left[near])
            reached.extend(left[near])
            left = left[~near]
    return found


def _links_in_keys(keyed: DataFrame, most: int) -> DataFrame:
    """Links between fingerprints of one key: (key, print) in, (a, b) out, streamed over sorted keys."""

    def make(batches):
        def linked(keys, prints):
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            sizes = np.diff(np.r_[starts, len(keys)])
            first = starts[sizes == 2]
            close = np.bitwise_count(prints[first] ^ prints[first + 1]) <= most
            signed = prints.view(np.int64)
            yield from zip(signed[first[close]].tolist(), signed[first[close] + 1].tolist())
            for start, size in zip(starts[sizes > 2], sizes[sizes > 2]):
                own = signed[start : start + size]
                for i, j in _forest(prints[start : start + size], most):
                    yield int(own[i]), int(own[j])

        held = (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.concatenate([held[0], batch.column("key").to_numpy()])
            prints = np.concatenate([held[1], batch.column("print").to_numpy().view(np.uint64)])
            cut = int(np.searchsorted(keys, keys[-1]))  # the last key may go on in the next batch
            yield from linked(keys[:cut], prints[:cut]) if cut else ()
            held = keys[cut:], prints[cut:]
        if len(held[0]):
            yield from linked(*held)

    return map_rows(keyed.repartition("key").sortWithinPartitions("key", "print"), make, "a long, b long")


def _golay_keyed(prints: DataFrame) -> DataFrame:
    def make(batches):
        for batch in batches:
            values = batch.column("print").to_numpy()
            for start in range(0, len(values), 4096):
                part = values[start : start + 4096]
                rows, keys = golay_keys(part.view(np.uint64))
                yield from zip(keys.tolist(), part[rows].tolist())

    return map_rows(prints, make, "key long, print long")


def near_prints(prints: DataFrame, run: RunTables, most: int = 2, hot_key: int = HOT_KEY, name: str = "keyed") -> DataFrame:
    """Links (a, b) that join all different fingerprints (print) within ``most`` (2 or fewer) bits.

    A key with more than ``hot_key`` fingerprints is not gathered: these get the words within one bit as
    keys instead, each of which has 65 fingerprints at most; two within two bits share such a word.
    """
    if most > 2:
        raise ValueError("one error in each fingerprint reaches pairs that differ in two bits at most")
    keyed = run.write(_golay_keyed(prints), name)
    # Keys of one fingerprint alone are dropped before the sort.
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    kept = keyed.join(sizes, "key")
    flips = [F.lit(0).cast("long"), *(F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(64))]
    hot = (
        kept.filter(F.col("n") > hot_key).select("print").distinct()
        .select(F.explode(F.array(*(F.col("print").bitwiseXOR(f) for f in flips))).alias("key"), "print")
    )
    cool = kept.filter(F.col("n") <= hot_key).select("key", "print")
    return _links_in_keys(cool, most).union(_links_in_keys(hot, most))


def simhash_dedup(documents: DataFrame, most: int = 2, shingle: int = 3, hot_key: int = HOT_KEY, tables: int = 1) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id, print_rows.

    Documents link when their fingerprints differ in ``most`` bits or fewer, with several ``tables`` those of
    any table (each has its own hashes of the same shingles; the fingerprint shown is the first).
    component_id is the smallest doc_id that links reach, the row's own included; print_rows is the number
    of rows with that very fingerprint. A null, empty or blank text has fingerprint zero and links like
    others. Rows may repeat a doc_id. A row without one takes part in linking and has the
    component_id of the rest (null if no row of its component has an id). An empty table gives no
    rows. Other columns are not read.
    """
    return _components(documents, most, shingle, hot_key, tables).drop("row_key")


def _table_links(prints: DataFrame, table: int, run: RunTables, most: int, hot_key: int) -> DataFrame:
    """Links (a, b) between first fingerprints whose documents are close in another table."""
    own = run.write(
        prints.select("print", F.element_at("more", table).alias("other")).groupBy("other")
        .agg(F.min("print").alias("node"), F.max("print").alias("last")),
        f"table-{table}",
    )
    # Documents with the same fingerprint here may have several there; one stands for all.
    shared = own.filter("node < last").select("other", "node")
    same = prints.select("print", F.element_at("more", table).alias("other")).join(shared, "other").filter("print <> node")
    close = near_prints(own.select(F.col("other").alias("print")), run, most, hot_key, f"keyed-{table}")
    nodes = own.select("other", "node")
    close = close.join(nodes.withColumnsRenamed({"other": "a", "node": "x"}), "a").join(nodes.withColumnsRenamed({"other": "b", "node": "y"}), "b")
    links = same.select(F.col("node").alias("a"), F.col("print").alias("b")).union(close.select("x", "y"))
    return run.write(links.filter("a <> b").distinct(), f"found-{table}")


def _components(documents: DataFrame, most: int, shingle: int, hot_key: int, tables: int) -> DataFrame:
    run = RunTables(documents.sparkSession)
    prints = run.write(_prints(documents, shingle, tables), "prints")
    classes = run.write(
        prints.groupBy("print").agg(F.min("doc_id").alias("least"), F.count("*").alias("print_rows")), "classes"
    )
    links = run.write(near_prints(classes.select("print"), run, most, hot_key), "found")
    for table in range(1, tables):
        links = links.union(_table_links(prints, table, run, most, hot_key))
    joined = components(links, run).withColumnRenamed("node", "print")
    of_class = classes.join(joined, "print", "left").withColumn("component", F.coalesce("component", "print"))
    least = of_class.groupBy("component").agg(F.min("least").alias("component_id"))
    of_print = run.write(of_class.join(least, "component").select("print", "component_id", "print_rows"), "of_print")
    return prints.join(of_print, "print").select(
        "doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id", "print_rows", "row_key"
    )


def shingle_set(text: bytes, width: int = NEAR_WORDS, seed: int = 42) -> np.ndarray:
    """Hashes of the different shingles, sorted; a text of fewer words is one shingle, a blank one has none."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    parts = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else iter([b" ".join(words)])
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(seed)), np.uint64))


def band_keys(own: np.ndarray) -> list[int]:
    """A key for each band of minima, from the hashes of ``shingle_set``."""
    import xxhash

    factors = mixed(np.arange(BANDS * MINIMA, dtype=np.uint64), 1) | np.uint64(1)
    least = np.full(len(factors), np.iinfo(np.uint64).max)
    for start in range(0, len(own), BLOCK):
        least = np.minimum(least, (own[start : start + BLOCK, None] * factors).min(axis=0))
    bands = least.astype("<u8").reshape(BANDS, MINIMA)
    return [_signed(xxhash.xxh64_intdigest(band.tobytes(), seed=n)) for n, band in enumerate(bands)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def in_common(first: np.ndarray, second: np.ndarray) -> int:
    return len(np.intersect1d(first, second, assume_unique=True))


def are_near(first: np.ndarray, second: np.ndarray) -> bool:
    """Whether two sets have 0.8 of what is in either in common."""
    return _enough(in_common(first, second), len(first), len(second))


def _enough(common: int, first: int, second: int) -> bool:
    return FIVE * common >= FOUR * (first + second - common)


def _sizes_allow(a: str, b: str):
    """Sets of such sizes can have 0.8 in common."""
    return FIVE * F.least(a, b) >= FOUR * F.greatest(a, b)


def _sketches(documents: DataFrame, shingle: int, tables: int) -> DataFrame:
    """Of each row: its node (the same for equal shingle sets), the size of its set, fingerprints and bands."""

    def make(batches):
        import xxhash

        for batch in batches:
            for (doc_id, text), key in zip(doc_texts([batch]), batch.column("row_key").to_pylist()):
                own = shingle_set(text)
                node = _signed(xxhash.xxh64_intdigest(own.astype("<u8").tobytes()))
                yield doc_id, key, node, len(own), [_signed(v) for v in fingerprints(text, shingle, tables=tables)], band_keys(own)

    keyed = id_and_text(documents).withColumn("row_key", row_key())
    return map_rows(keyed, make, "doc_id long, row_key long, node long, size long, prints array<long>, bands array<long>")


def _sets(documents: DataFrame, wanted: DataFrame, nodes: DataFrame, run: RunTables) -> DataFrame:
    """(node, own), the shingle sets of the nodes wanted. Only texts of such nodes are moved."""

    def sets(batches):
        for batch in batches:
            for node, text in zip(batch.column("node").to_pylist(), batch.column("body").to_pylist()):
                yield node, shingle_set(text).view(np.int64)

    rows = nodes.join(wanted, "node").select("node", F.col("row.doc_id").alias("id"), F.col("row.row_key").alias("rk"))
    text = id_and_text(documents).withColumn("row_key", row_key())
    bodies = (
        text.join(rows.hint("shuffle_hash"), (F.col("row_key") == F.col("rk")) & F.col("doc_id").eqNullSafe(F.col("id")))
        .select("node", F.coalesce("text", F.lit("")).cast("binary").alias("body")).dropDuplicates(["node"])
    )
    return run.write(map_rows(bodies, sets, "node long, own array<long>", weigh=lambda row: 8 * len(row[1])), "sets")


def _near(pairs: DataFrame, sets: DataFrame, run: RunTables, name: str) -> DataFrame:
    """(a, b, common, near) of pairs of nodes: the shingles in common, and whether these are 0.8 of what is in either."""

    def compare(batches):
        for batch in batches:
            first, second = batch.column("first"), batch.column("second")
            for i, (a, b) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())):
                one, other = first[i].values.to_numpy(), second[i].values.to_numpy()
                common = in_common(one, other)
                yield a, b, common, _enough(common, len(one), len(other))

    both = (
        pairs.join(sets.withColumnsRenamed({"node": "a", "own": "first"}), "a")
        .join(sets.withColumnsRenamed({"node": "b", "own": "second"}), "b")
    )
    return run.write(map_rows(both, compare, "a long, b long, common long, near boolean"), f"{name}-near")


def _alone(shared: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, alone): how many of its shingles no other node of a crowded bucket has."""
    crowded = shared.filter(F.col("members") > FEW).select("node").distinct()
    held = sets.join(crowded, "node", "left_semi").select("node", F.explode("own").alias("shingle"))
    single = held.groupBy("shingle").agg(F.count("*").alias("n"), F.min("node").alias("node")).filter("n = 1")
    return single.groupBy("node").agg(F.count("*").alias("alone"))


def _missed(shared: DataFrame, joined: DataFrame, met: DataFrame) -> DataFrame:
    """Pairs (a, b) of a bucket in different components that may be near and have not been looked at.

    One of them, a, lies outside of the component of the bucket's first node. Of its |a| shingles those that stand
    alone are not in b, so the two have at most |a| - alone in common and |b| + alone in either: b has to
    have 1.25 |a| - 2.25 alone shingles or fewer, and 0.8 |a| or more. In a crowded bucket rows meet by bins of
    sizes, so that a row finds those of such sizes only; the same bound holds the other way round.

    There ``met`` also tells how many shingles of the first node, f, each row lacks, and how many of its own are not in f
    and yet in others. Two rows have in common at most what f has, less the greater lack, and the lesser number of
    such others. As a is not near f, a row b with e shingles that f lacks, s of them in others, is near a only if
    9 s > 4 e - 4 of those it lacks: copies of f with changes of their own meet nobody.
    """
    of_node = joined.withColumnRenamed("component", "own")
    of_first = joined.select(F.col("node").alias("first"), F.col("component").alias("its"))
    rows = (
        shared.filter(F.col("node") != F.col("first")).join(of_node, "node", "left").join(of_first, "first", "left")
        .withColumn("own", F.coalesce("own", "node")).withColumn("its", F.coalesce("its", "first"))
        .withColumn("most", F.floor((FIVE * F.col("size") - (FOUR + FIVE) * F.col("alone")) / FOUR).cast("int"))
        .withColumn("outside", F.col("own") != F.col("its"))
        .filter(F.col("most") >= F.ceil(FOUR * F.col("size") / FIVE))
    )
    low = F.ceil(FOUR * F.col("size") / FIVE)
    first, last = F.col("size_b") >= F.col("low_a"), F.col("size_b") <= F.col("most_a")
    apart = (F.col("own_a") != F.col("own_b")) & first & last & (F.col("size_a") <= F.col("most_b"))
    in_common = F.col("size_first_a") - F.greatest("lacks_a", "lacks_b") + F.least("others_a", "others_b")
    reach = (FOUR + FIVE) * in_common >= FOUR * (F.col("size_a") + F.col("size_b"))

    def side(df, end, *more):
        return df.select(
            "key", "bin", F.col("node").alias(end), F.col("size").alias(f"size_{end}"), F.col("most").alias(f"most_{end}"),
            low.alias(f"low_{end}"), F.col("own").alias(f"own_{end}"), *(F.col(c).alias(f"{c}_{end}") for c in more),
        )

    def bin_of(size):
        return F.floor(F.ln(size) * BINS).cast("int")

    def pairs(one, every, found):
        same = (one.key == every.key) & (one.bin == every.bin)
        return one.join(every, same & found).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    # Few members meet as they are; many by the bins that their sizes allow.
    few = rows.filter(F.col("members") <= FEW).withColumn("bin", F.lit(0))
    ends = (F.least("first", "node") == F.col("a")) & (F.greatest("first", "node") == F.col("b"))
    many = (
        rows.filter(F.col("members") > FEW).join(met.select("a", "b", "common"), ends)
        .withColumn("lacks", F.col("size_first") - F.col("common"))
        .withColumn("others", F.col("size") - F.col("common") - F.col("alone"))
    )
    found = (FOUR + FIVE) * F.col("others") > FOUR * (F.col("size") - F.col("size_first"))
    bins = F.explode(F.sequence(bin_of(low), bin_of(F.col("most"))))
    some = pairs(side(few.filter("outside"), "a"), side(few, "b"), apart)
    more = pairs(
        side(many.filter("outside").withColumn("bin", bins), "a", "size_first", "lacks", "others"),
        side(many.filter(found).withColumn("bin", bin_of(F.col("size"))), "b", "lacks", "others"),
        apart & reach,
    )
    return some.union(more).distinct()


def _near_components(documents: DataFrame, most: int, shingle: int, tables: int) -> DataFrame:
    """(doc_id, row_key, stays) of each row; links are pairs of texts with 0.8 of their shingles in common.

    Looked at are, first, links between fingerprints and each bucket of a band against its first node, in a crowded
    one the node with the fewest shingles that stand alone, to which the rest of a group of copies is nearest; then
    those pairs of a bucket that this has not joined and that can be near by the shingles that stand alone. A
    large group of near copies costs a pair for each row and band, and so does a passage that
    many otherwise different texts share.
    """
    run = RunTables(documents.sparkSession)
    rows = run.write(_sketches(documents, shingle, tables), "sketches")
    nodes = run.write(
        rows.groupBy("node").agg(
            # a row without id comes last
            F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row_key")).alias("row"),
            F.min(F.struct("size", "prints", "bands")).alias("of"),
        ).select("node", "row", "of.*"),
        "nodes",
    )
    buckets = nodes.select(F.explode("bands").alias("key"), "node", "size")
    sizes = buckets.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    shared = run.write(buckets.join(sizes, "key"), "shared")
    prints = nodes.select(F.col("node").alias("print"), F.col("prints").alias("more"))
    close = None
    for table in range(1, tables + 1):
        found = _table_links(prints, table, run, most, HOT_KEY)
        run.drop(f"keyed-{table}")
        close = found if close is None else close.union(found)
    wanted = shared.select("node").union(close.select(F.col("a").alias("node"))).union(close.select("b")).distinct()
    sets = _sets(documents, wanted, nodes, run)
    known = shared.join(run.write(_alone(shared, sets), "alone"), "node", "left").withColumn("alone", F.coalesce("alone", F.lit(0)))
    firsts = known.groupBy("key").agg(F.min(F.struct("alone", "node", "size")).alias("of"))
    shared = run.write(known.join(firsts.select("key", F.col("of.node").alias("first"), F.col("of.size").alias("size_first")), "key"), "led")
    # In a crowded bucket all meet the first one, as what they have in common with it tells which others can be near.
    meet = (F.col("members") > FEW) | _sizes_allow("size", "size_first")
    pairs = shared.filter(F.col("node") != F.col("first")).filter(meet).select("first", "node").union(close.select("a", "b"))
    pairs = pairs.select(F.least("first", "node").alias("a"), F.greatest("first", "node").alias("b")).distinct()
    met = _near(pairs, sets, run, "first")
    links = met.filter("near").select("a", "b")
    joined = run.write(components(links, run), "joined")
    links = links.union(_near(_missed(shared, joined, met), sets, run, "missed").filter("near").select("a", "b"))
    joined = components(links, run, "all").withColumnRenamed("component", "of_links")
    run.drop("sets")
    of_node = nodes.select("node", "row").join(joined, "node", "left").withColumn("of_links", F.coalesce("of_links", "node"))
    least = of_node.groupBy("of_links").agg(F.min("row").alias("first"))
    of_node = run.write(of_node.join(least, "of_links").select("node", "first"), "of_node")
    own = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row_key")
    return rows.join(of_node, "node").select("doc_id", "row_key", own.eqNullSafe(F.col("first")).alias("stays"))


def drop_near_copies(documents: DataFrame, most: int = 2, shingle: int = 3, tables: int = 8) -> DataFrame:
    """One row of each component of ``documents``, that with the least id, with all its columns.

    Two texts link when their sets of five-word shingles (lower-cased A-Z, any white space between words)
    have a Jaccard similarity of 0.8 or more, which is counted for each pair that fingerprints or bands name.
    Of all pairs at 0.8 three in 100,000 are not named, at 0.85 fewer than one in a million. A text of fewer words is
    one shingle; null, empty and blank texts have none and are copies of each other. Of rows that share the least
    id, or repeat as a whole, one stays; a row without id stays only in a component without any. Texts of
    any length are read whole; an empty table stays empty. Columns may have any names.
    """
    run = RunTables(documents.sparkSession)
    found = run.write(_near_components(documents, most, shingle, tables), "found-rows")
    repeated = found.filter("stays").groupBy("doc_id", "row_key").count().filter("count > 1")
    return without(documents, found.filter(~F.col("stays")), run.write(repeated, "repeated"))
