"""Interpolated modified Kneser-Ney language model of order 2, counted in Spark and stored as sorted hash arrays.

Counting: each task hashes its tokens (XXH64), counts them with a sort, and sends sorted runs of (key, count) to buckets
that are ranges of the key; a bucket merges its runs and writes one sorted array. The token array gives each token its
rank as id; a bigram's key is (id of the first, id of the second). Bigram buckets are cut where the counts say so: a
frequent first word is spread over several buckets by its second word, so no bucket is much larger than the others. What
tasks send grows with the corpus; the driver gets a few numbers for each bucket.

The arrays lie in the shared folder and workers memory-map them, so a model needs no room in their memory and many
workers of a machine share its pages. Queries are sorted before a search, to read the arrays in order.

p(w | u) = (c(u,w) - D(c(u,w))) / c(u) + g(u) p1(w), p1(w) = (b(w) - D'(b(w))) / B + g1 / (V + 1), with b(w) the number of
different words before w, B all different bigrams, and discounts for counts 1, 2 and 3 or more from the counts of
counts. Texts open with a context of their own and close with an end token. Unknown words get the share of an unseen one.

Cases: null and empty texts are an end token; null ids hash as empty text for the split; repeated rows count as often as
they come; very long texts are read whole; with nothing to train on every token has probability 1. Ids have 32 bits: more
different words than that are an error. Counts have 64 bits; of bigrams 32 are stored, and larger ones apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossloom.llm.arrays import columns, store
from glossloom.llm.common import new_dir, written

#: No word holds a space, so this is no word's hash but for a collision.
END_HASH = xxhash.xxh64_intdigest(b" ", 42)
#: Tokens that a task holds before it counts them.
CHUNK = 1_500_000
#: Tokens of a bucket, about.
BUCKET_TOKENS = 3_000_000
#: Bigram counts above are stored apart.
MOST_STORED = (1 << 32) - 1


# ---- sorted runs on their way through the shuffle


def planes(values: np.ndarray) -> bytes:
    """Bytes by significance: those of small differences are mostly zero, which Spark's shuffle compression takes out."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def unplanes(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8).reshape(width, -1).T.copy().view(kind).ravel()


def run_rows(keys: np.ndarray, counts: np.ndarray, buckets: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket of a sorted run; buckets are ascending."""
    edge = np.concatenate([[0], np.nonzero(np.diff(buckets))[0] + 1, [len(keys)]]) if len(keys) else np.array([0])
    rows = [(int(buckets[a]), planes(np.diff(keys[a:b], prepend=np.uint64(0))), planes(counts[a:b].astype(np.uint32))) for a, b in zip(edge, edge[1:], strict=False)]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "keys", "counts"])


RUN = "bucket long, keys binary, counts binary"


def merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([np.cumsum(unplanes(b.as_py(), "<u8"), dtype=np.uint64) for b in table.column("keys")])
    counts = np.concatenate([unplanes(b.as_py(), "<u4") for b in table.column("counts")]).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.concatenate([[0], np.nonzero(np.diff(keys))[0] + 1])
    return keys[first], np.add.reduceat(counts, first)


# ---- tokens


def token_hashes(text: str | None) -> list[int]:
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    out = [xxhash.xxh64_intdigest(w, 42) for w in words]
    out.append(END_HASH)
    return out


def chunks(batches: Iterator[pa.RecordBatch], column: int = 0, most: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of consecutive texts and the texts' lengths in tokens."""
    held: list[int] = []
    lengths: list[int] = []
    for batch in batches:
        for text in batch.column(column):
            got = token_hashes(text.as_py())
            held += got
            lengths.append(len(got))
            if len(held) >= most:
                yield np.array(held, np.uint64), np.array(lengths)
                held, lengths = [], []
    if held:
        yield np.array(held, np.uint64), np.array(lengths)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Of counts 1, 2 and 3 or more, from the numbers of keys with counts 1 to 4."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    out = [k - (k + 1) * y * b / a if a else k / 2 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(min(max(d, 0.0), float(k)) for k, d in zip((1, 2, 3), out, strict=True))


def discounted(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.where(c <= 0, 0.0, np.where(c == 1, d[0], np.where(c == 2, d[1], d[2])))


@dataclass
class Model:
    """Numbers and places; the arrays stay in the folder."""

    at: str
    bits: int
    sizes: list[int] = field(default_factory=list)  # tokens of each unigram bucket, by kind
    totals: list[int] = field(default_factory=list)  # their counts
    docs: int = 0
    pair_sizes: list[int] = field(default_factory=list)
    context_sizes: list[int] = field(default_factory=list)
    large: dict = field(default_factory=dict)  # buckets with counts above MOST_STORED, and how many
    shared: dict = field(default_factory=dict)  # the first and last context of each bucket, which may go on in others
    d2: tuple = (0.5, 1.0, 1.5)
    d1: tuple = (0.5, 1.0, 1.5)
    bigrams: int = 0
    mass: float = 1.0

    def __post_init__(self) -> None:
        self.spread()

    def spread(self) -> None:
        self.bases = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(self.totals)]).astype(np.int64)
        self.types, self.tokens = int(self.bases[-1]), int(self.before[-1])

    # unigrams

    def unigram(self, b: int) -> list[np.ndarray]:
        """keys, counts, counts before, of a bucket."""
        return columns(f"{self.at}/uni-{b}", self.sizes[b], ["<u8", "<i8", "<i8"])

    def continuation(self, b: int) -> np.ndarray:
        return columns(f"{self.at}/cont-{b}", self.sizes[b], ["<i8"])[0]

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """id (-1: unknown) and count of sorted hashes."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        bucket = (hashes >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), np.int64)
        edge = np.searchsorted(bucket, np.arange(len(self.sizes) + 1))
        for b in np.nonzero(np.diff(edge))[0]:
            if not self.sizes[b]:
                continue
            keys, c, _ = self.unigram(b)
            part = hashes[edge[b] : edge[b + 1]]
            at = np.minimum(np.searchsorted(keys, part), len(keys) - 1)
            ok = keys[at] == part
            ids[edge[b] : edge[b + 1]] = np.where(ok, at + self.bases[b], -1)
            counts[edge[b] : edge[b + 1]] = np.where(ok, c[at], 0)
        return ids, counts

    def of_ids(self, ids: np.ndarray, what: str) -> np.ndarray:
        """Count ('c'), counts before ('cum') or continuation ('b') of sorted known ids; id `types` is a text's opening."""
        out = np.zeros(len(ids), np.int64)
        edge = np.searchsorted(ids, self.bases)
        for b in np.nonzero(np.diff(edge))[0]:
            local = ids[edge[b] : edge[b + 1]] - self.bases[b]
            if what == "b":
                out[edge[b] : edge[b + 1]] = self.continuation(b)[local]
            else:
                _, c, cum = self.unigram(b)
                out[edge[b] : edge[b + 1]] = c[local] if what == "c" else cum[local] + self.before[b]
        rest = slice(edge[-1], None)
        out[rest] = self.docs if what == "c" else self.tokens if what == "cum" else 0
        return out

    # bigrams

    def pair_buckets(self, keys: np.ndarray) -> np.ndarray:
        """The bucket of sorted keys: their place if a first word's bigrams were spread evenly over its count."""
        first = (keys >> np.uint64(32)).astype(np.int64)
        second = (keys & np.uint64(0xFFFFFFFF)).astype(np.float64)
        return self.place(first, second)

    def place(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        u, back = np.unique(first, return_inverse=True)
        c, cum = self.of_ids(u, "c"), self.of_ids(u, "cum")
        inside = np.minimum((c[back] * (second / max(self.types, 1))).astype(np.int64), c[back] - 1)
        return (cum[back] + inside) // BUCKET_TOKENS

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted keys."""
        out = np.zeros(len(keys), np.int64)
        if not len(keys):
            return out
        buckets = self.pair_buckets(keys)
        edge = np.searchsorted(buckets, np.arange(len(self.pair_sizes) + 1))
        for b in np.nonzero(np.diff(edge))[0]:
            if not self.pair_sizes[b]:
                continue
            stored, counts = columns(f"{self.at}/pair-{b}", self.pair_sizes[b], ["<u8", "<u4"])
            part = keys[edge[b] : edge[b + 1]]
            at = np.minimum(np.searchsorted(stored, part), len(stored) - 1)
            out[edge[b] : edge[b + 1]] = np.where(stored[at] == part, counts[at], 0)
            if b in self.large:
                stored, counts = columns(f"{self.at}/large-{b}", self.large[b], ["<u8", "<i8"])
                at = np.minimum(np.searchsorted(stored, part), len(stored) - 1)
                out[edge[b] : edge[b + 1]] = np.where(stored[at] == part, counts[at], out[edge[b] : edge[b + 1]])
        return out

    def backoff(self, u: np.ndarray) -> np.ndarray:
        """g(u) * c(u) of sorted known contexts."""
        out = np.zeros(len(u))
        if not len(u):
            return out
        buckets = self.place(u, np.zeros(len(u)))
        edge = np.searchsorted(buckets, np.arange(len(self.context_sizes) + 1))
        for b in np.nonzero(np.diff(edge))[0]:
            if not self.context_sizes[b]:
                continue
            ids, n1, n2, n3 = columns(f"{self.at}/ctx-{b}", self.context_sizes[b], ["<i8"] * 4)
            part = u[edge[b] : edge[b + 1]]
            at = np.minimum(np.searchsorted(ids, part), len(ids) - 1)
            out[edge[b] : edge[b + 1]] = np.where(ids[at] == part, self.d2[0] * n1[at] + self.d2[1] * n2[at] + self.d2[2] * n3[at], 0.0)
        for i in np.nonzero(np.isin(u, list(self.shared)))[0]:
            out[i] = float(np.dot(self.d2, self.shared[int(u[i])]))
        return out

    # probabilities

    def score(self, hashes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: known tokens, base score and log10 probability."""
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        kinds, back = np.unique(hashes, return_inverse=True)
        kind_ids, kind_counts = self.ids(kinds)
        ids, counts = kind_ids[back], kind_counts[back]
        base = np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.types + 1)))
        unseen = 1.0 / (self.types + 1)
        if self.bigrams:
            known = np.nonzero(kind_ids >= 0)[0]
            b = np.zeros(len(kinds), np.int64)
            b[known] = self.of_ids(kind_ids[known], "b")  # ids ascend with the hashes
            p1 = ((b - discounted(b, self.d1)) / self.bigrams + self.mass * unseen)[back]
            before = np.concatenate([[self.types], ids[:-1]])
            before[starts] = self.types
            u, u_back = np.unique(before, return_inverse=True)
            real = u >= 0
            g, c_u = np.zeros(len(u)), np.zeros(len(u), np.int64)
            g[real], c_u[real] = self.backoff(u[real]), self.of_ids(u[real], "c")
            both = np.nonzero((before >= 0) & (ids >= 0))[0]
            pairs, p_back = np.unique((before[both].astype(np.uint64) << np.uint64(32)) | ids[both].astype(np.uint64), return_inverse=True)
            c = np.zeros(len(ids), np.int64)
            c[both] = self.pair_counts(pairs)[p_back]
            c_before = c_u[u_back]
            safe = np.maximum(c_before, 1)
            p = np.where(c_before > 0, (c - discounted(c, self.d2)) / safe + g[u_back] / safe * p1, p1)
        else:
            p = np.full(len(ids), unseen)
        return np.add.reduceat((counts > 0).astype(np.int64), starts), np.add.reduceat(base, starts), np.add.reduceat(np.log10(p), starts)


# ---- training


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 5 == 1


def train(texts: DataFrame, text: str = "text") -> Model:
    """The model of a table's texts, its arrays in a new folder of the shared one."""
    spark = texts.sparkSession
    at = new_dir(spark, "lm")
    texts = texts.select(F.col(text).alias("text"))
    size, docs = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    bits = max(0, int(np.ceil(np.log2(max(1, size / 6 / BUCKET_TOKENS)))))
    buckets = 1 << bits

    def count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hashes, _ in chunks(batches):
            keys, counts = np.unique(hashes, return_counts=True)
            yield run_rows(keys, counts, (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64))

    def keep_tokens(table: pa.Table) -> pa.Table:
        keys, counts = merged(table)
        b = table.column("bucket")[0].as_py()
        store(f"{at}/uni-{b}", [keys, counts, np.cumsum(counts) - counts])
        return pa.table({"bucket": [b], "n": [len(keys)], "total": [int(counts.sum())]})

    got = texts.mapInArrow(count_tokens, RUN).groupBy("bucket").applyInArrow(keep_tokens, "bucket long, n long, total long").collect()
    sizes, totals = [0] * buckets, [0] * buckets
    for b, n, total in got:
        sizes[b], totals[b] = n, total
    model = Model(at, bits, sizes, totals, docs)
    if model.types >= 1 << 32:
        raise ValueError(f"{model.types} different words; ids have 32 bits")
    if not model.tokens:
        return model

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hashes, lengths in chunks(batches):
            kinds, back = np.unique(hashes, return_inverse=True)
            ids = model.ids(kinds)[0][back]
            before = np.concatenate([[model.types], ids[:-1]])
            before[np.concatenate([[0], np.cumsum(lengths)[:-1]])] = model.types
            keys, counts = np.unique((before.astype(np.uint64) << np.uint64(32)) | ids.astype(np.uint64), return_counts=True)
            yield run_rows(keys, counts, model.pair_buckets(keys))

    def keep_pairs(table: pa.Table) -> pa.Table:
        keys, counts = merged(table)
        b = table.column("bucket")[0].as_py()
        large = counts > MOST_STORED
        store(f"{at}/pair-{b}", [keys, np.minimum(counts, MOST_STORED).astype("<u4")])
        if large.any():
            store(f"{at}/large-{b}", [keys[large], counts[large]])
        first = (keys >> np.uint64(32)).astype(np.int64)
        edge = np.concatenate([[0], np.nonzero(np.diff(first))[0] + 1])
        u = first[edge]
        n = [np.add.reduceat(x.astype(np.int64), edge) for x in (counts == 1, counts == 2, counts > 2)]
        store(f"{at}/ctx-{b}", [u, *n])
        # the words after them, to their own buckets
        w, times = np.unique(keys & np.uint64(0xFFFFFFFF), return_counts=True)
        runs = run_rows(w, times, np.searchsorted(model.bases, w.astype(np.int64), "right") - 1)
        ends = [[int(x) for x in (u[i], n[0][i], n[1][i], n[2][i])] for i in dict.fromkeys((0, len(u) - 1))]
        stats = [len(keys), len(u), int(large.sum()), *[int((counts == k).sum()) for k in (1, 2, 3, 4)], *[x for e in ends for x in e]]
        rows = runs.num_rows
        return pa.table({
            "src": pa.array([b] * (rows + 1), pa.int64()),
            "bucket": pa.concat_arrays([runs.column(0), pa.array([-1], pa.int64())]),
            "keys": pa.concat_arrays([runs.column(1), pa.array([b""], pa.binary())]),
            "counts": pa.concat_arrays([runs.column(2), pa.array([b""], pa.binary())]),
            "stats": pa.array([None] * rows + [stats], pa.list_(pa.int64())),
        })

    pairs = written(texts.mapInArrow(count_pairs, RUN).groupBy("bucket").applyInArrow(keep_pairs, f"src long, {RUN}, stats array<long>"), "pairs")
    stats = pairs.filter("bucket = -1").select("src", "stats").orderBy("src").collect()
    n_buckets = max(b for b, _ in stats) + 1
    model.pair_sizes, model.context_sizes = [0] * n_buckets, [0] * n_buckets
    of, ends = [0] * 4, {}
    for b, s in stats:
        model.pair_sizes[b], model.context_sizes[b] = s[0], s[1]
        if s[2]:
            model.large[b] = s[2]
        of = [x + y for x, y in zip(of, s[3:7], strict=True)]
        for i in range(7, len(s), 4):
            ends.setdefault(s[i], []).append(s[i + 1 : i + 4])
    model.shared = {u: [sum(x) for x in zip(*parts, strict=True)] for u, parts in ends.items()}
    model.d2, model.bigrams = discounts(of), sum(model.pair_sizes)

    def keep_continuations(table: pa.Table) -> pa.Table:
        keys, counts = merged(table)
        b = table.column("bucket")[0].as_py()
        dense = np.zeros(model.sizes[b], np.int64)
        dense[keys.astype(np.int64) - model.bases[b]] = counts
        store(f"{at}/cont-{b}", [dense])
        return pa.table({"n": [[int((dense == k).sum()) for k in (1, 2, 3, 4)] + [int((dense > 2).sum())]]})

    n = pairs.filter("bucket >= 0").select("bucket", "keys", "counts").groupBy("bucket").applyInArrow(keep_continuations, "n array<long>").collect()
    n = [sum(x) for x in zip(*[r[0] for r in n], strict=True)]
    model.d1 = discounts(n[:4])
    model.mass = (model.d1[0] * n[0] + model.d1[1] * n[1] + model.d1[2] * n[4]) / model.bigrams
    return model


def with_scores(df: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of each row; a text's perplexity is 10 ** (-score / n_tokens)."""
    kind = dict(df.dtypes)[doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = batch.column(0), 0
            for hashes, lengths in chunks(iter([batch]), 1):
                known, base, score = model.score(hashes, lengths)
                part = ids.slice(at, len(lengths))
                at += len(lengths)
                yield pa.RecordBatch.from_arrays([part, pa.array(lengths, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(score)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")
